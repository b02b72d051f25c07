"""Detection queries: both passes over document texts, and what is done with what they find."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import emails, fixed, phones
from ..functions.spans import left_context, line_prefix, spans
from ..operators import detect
from ..sources.records import CARDS_SQL, WORDS_SQL, cards, words
from ..sources.tables import table
from .registry import Catalog, quoted

CATALOG = Catalog()
query = CATALOG.query

#: Matches with places, in SQL: lengths of what lies between matches and of the matches, summed up to each.
def matches_sql(name: str, pattern: str, source: str = "documents") -> str:
    p = quoted(pattern)
    return f"""{name}0 AS (SELECT doc_id, text, regexp_extract_all(text, {p}) AS f, string_split_regex(text, {p}) AS g FROM {source} WHERE regexp_matches(text, {p})),
{name}1 AS (SELECT doc_id, text, f, g, unnest(range(1, len(f) + 1)) AS k FROM {name}0),
{name} AS (SELECT doc_id, text, CAST(k - 1 AS INTEGER) AS ord, f[k] AS value,
  CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM {name}1)"""


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^\\p{{Nd}}]', '', 'g')"


def _full(patterns: tuple[str, ...]) -> str:
    return quoted(r"^(?:" + "|".join(patterns) + r")\z")


ONE_PASS = f"""{matches_sql('c', fixed.PHONE_CANDIDATE)},
cc AS (SELECT doc_id, ord, value, start, regexp_replace(regexp_replace(value, '^[\\s.\\-–—]+', ''), '[\\s.\\-–—]+\\z', '') AS cand,
  string_split(substr(text, greatest(start - {fixed.LEFT_CONTEXT}, 0) + 1, least(start, {fixed.LEFT_CONTEXT})), chr(10))[-1] AS pre FROM c),
cg AS (SELECT *, length({_digits('cand')}) AS n, regexp_extract_all(cand, '\\p{{Nd}}+') AS groups FROM cc),
phones AS (SELECT doc_id, ord, start, trim(value) AS value, CASE WHEN n NOT BETWEEN 7 AND 15 THEN false
  WHEN len(list_filter(groups, lambda g: regexp_matches(g, '^(?:19|20)\\p{{Nd}}\\p{{Nd}}\\z'))) >= 2 THEN false
  WHEN len(groups) >= 3 AND len(list_filter(groups, lambda g: length(g) <> 4)) = 0 THEN false
  WHEN regexp_matches(pre, {quoted(fixed.ID_LABEL)}) THEN false
  WHEN starts_with(cand, '+') THEN true
  WHEN regexp_matches(pre, {quoted(fixed.PHONE_LABEL)}) THEN true
  ELSE regexp_matches(cand, {_full(fixed.PHONE_SHAPES)}) END AS ok FROM cg)"""


@query(f"SELECT doc_id, {_digits('text')} AS digits FROM documents")
def p01_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", phones.digits(F.col("text")).alias("digits"))


@query(f"WITH {matches_sql('m', fixed.EMAIL)} SELECT doc_id, ord, value AS email FROM m")
def p02_find_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter(F.col("text").contains("@"))
    return docs.select("doc_id", F.posexplode(emails.find_emails(F.col("text"))).alias("ord", "email"))


@query(f"WITH {matches_sql('m', fixed.PHONE_CANDIDATE)} SELECT doc_id, ord, start, CAST(start + length(value) AS INTEGER) AS \"end\", value FROM m")
def p03_phone_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.select("doc_id", F.posexplode(spans(F.col("text"), fixed.PHONE_CANDIDATE)).alias("ord", "s"))
    return rows.select("doc_id", "ord", "s.start", "s.end", "s.value")


@query(f"WITH {ONE_PASS} SELECT doc_id, start, pre FROM cc")
def p04_left_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = F.transform(spans(F.col("text"), fixed.PHONE_CANDIDATE), lambda s: F.struct(s["start"].alias("start"), left_context(F.col("text"), s["start"], fixed.LEFT_CONTEXT).alias("pre")))
    return docs.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.start", "s.pre")


@query(f"WITH {ONE_PASS} SELECT doc_id, start, value, ok AS is_phone FROM phones")
def p13_is_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 to P13: the decision list on every candidate."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    text = F.col("text")
    rows = F.transform(spans(text, fixed.PHONE_CANDIDATE), lambda s: F.struct(s["start"].alias("start"), F.trim(s["value"]).alias("value"), phones.is_phone(s["value"], left_context(text, s["start"], fixed.LEFT_CONTEXT)).alias("is_phone")))
    return docs.select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.start", "s.value", "s.is_phone")


@query(f"WITH {ONE_PASS} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS ord, value AS phone FROM phones WHERE ok")
def p14_find_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(phones.find_phones(F.col("text"))).alias("ord", "phone"))


@query(
    f"""WITH {ONE_PASS}, {matches_sql('m', fixed.EMAIL)},
both_kinds AS (SELECT doc_id, 0 AS k, ord, value, 'email' AS kind FROM m UNION ALL SELECT doc_id, 1, ord, value, 'phone' FROM phones WHERE ok),
firsts AS (SELECT doc_id, value, min(k * 1000000 + ord) AS "at", min(kind) AS kind FROM both_kinds GROUP BY doc_id, value)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY "at") - 1 AS INTEGER) AS ord, value, kind FROM firsts"""
)
def p15_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(table(spark, sf_dir, "documents", "doc_id", "text"))


@query(
    f"""WITH {matches_sql('r', fixed.RESIDUAL_RUN)}, d AS (SELECT doc_id, start, {_digits('value')} AS d FROM r)
SELECT doc_id, start, d AS digits, CASE WHEN length(d) = 14 AND starts_with(d, '0091') THEN substr(d, 5) WHEN length(d) = 13 AND starts_with(d, '091') THEN substr(d, 4)
  WHEN length(d) = 12 AND starts_with(d, '91') THEN substr(d, 3) WHEN length(d) = 11 AND starts_with(d, '0') THEN substr(d, 2) WHEN length(d) = 10 THEN d END AS nsn,
  coalesce(CASE WHEN length(d) = 14 AND starts_with(d, '0091') THEN substr(d, 5, 1) WHEN length(d) = 13 AND starts_with(d, '091') THEN substr(d, 4, 1)
  WHEN length(d) = 12 AND starts_with(d, '91') THEN substr(d, 3, 1) WHEN length(d) = 11 AND starts_with(d, '0') THEN substr(d, 2, 1) WHEN length(d) = 10 THEN d[1] END IN ('6','7','8','9'), false) AS mobile FROM d"""
)
def r01_r02_numbering_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.select("doc_id", F.explode(spans(F.col("text"), fixed.RESIDUAL_RUN)).alias("s")).select("doc_id", "s.start", phones.digits(F.col("s.value")).alias("digits"))
    return rows.select("doc_id", "start", "digits", phones.national_number(F.col("digits")).alias("nsn"), phones.is_mobile(F.col("digits")).alias("mobile"))


RUNS = f"""{matches_sql('r', fixed.RESIDUAL_RUN)},
runs AS (SELECT doc_id, start AS base, value AS run, string_split(substr(text, 1, start), chr(10))[-1] AS pre, substr(text, start + length(value) + 1, 1) AS post FROM r)"""


@query(f"WITH {RUNS} SELECT doc_id, base AS start, run, regexp_matches(pre, {quoted(fixed.ID_LABEL)}) AS vetoed FROM runs")
def r03_r04_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents", "doc_id", "text"), F.col("text")
    rows = F.transform(spans(text, fixed.RESIDUAL_RUN), lambda s: F.struct(s["start"].alias("start"), s["value"].alias("run"), phones.is_id_context(line_prefix(text, s["start"])).alias("vetoed")))
    return docs.select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.*")


WINDOWS = f"""{RUNS},
g0 AS (SELECT *, regexp_extract_all(run, '\\p{{Nd}}+') AS f, string_split_regex(run, '\\p{{Nd}}+') AS g FROM runs),
g1 AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM g0), g2 AS (SELECT *, unnest(range(i, least(len(f), i + 14) + 1)) AS j FROM g1),
g3 AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) END AS s,
  list_sum(list_transform(g[1:j], lambda x: length(x))) + list_sum(list_transform(f[1:j], lambda x: length(x))) AS e FROM g2),
g4 AS (SELECT *, substr(run, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)) AS cand, pre || substr(run, 1, CAST(s AS BIGINT)) AS before, substr(run || post, CAST(e AS BIGINT) + 1, 1) AS next FROM g3),
g5 AS (SELECT *, {_digits('cand')} AS d, regexp_extract_all(cand, '\\p{{Nd}}+') AS groups, trim(cand) AS c, regexp_matches(before, {quoted(fixed.PHONE_LABEL)}) AS label FROM g4),
g6 AS (SELECT *, CASE WHEN length(d) = 14 AND starts_with(d, '0091') THEN substr(d, 5) WHEN length(d) = 13 AND starts_with(d, '091') THEN substr(d, 4)
  WHEN length(d) = 12 AND starts_with(d, '91') THEN substr(d, 3) WHEN length(d) = 11 AND starts_with(d, '0') THEN substr(d, 2) WHEN length(d) = 10 THEN d END AS nsn FROM g5),
windows AS (SELECT doc_id, base, CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, CAST(base + s AS INTEGER) AS start, CAST(base + e AS INTEGER) AS "end",
  CASE WHEN length(d) NOT BETWEEN 7 AND 15 THEN false
  WHEN len(list_filter(groups, lambda x: regexp_matches(x, '^(?:19|20)\\p{{Nd}}\\p{{Nd}}\\z'))) >= 2 THEN false
  WHEN len(groups) >= 3 AND len(list_filter(groups, lambda x: length(x) <> 4)) = 0 THEN false
  WHEN contains(cand, '.') AND len(list_filter(groups, lambda x: length(x) NOT IN (3, 4))) > 0 THEN false
  WHEN regexp_matches(c, {quoted(fixed.DATE_RUN)}) THEN false
  WHEN len(groups) = 1 AND length(d) = 10 AND ends_with(d, '000000') AND NOT label THEN false
  WHEN regexp_matches(next, '^\\p{{L}}') THEN false
  WHEN regexp_matches(before, {quoted(fixed.ID_LABEL)}) THEN false
  WHEN regexp_matches(before, '\\p{{L}}\\z') AND NOT label THEN false
  WHEN coalesce(nsn[1] IN ('6','7','8','9'), false) THEN true
  WHEN starts_with(c, '+') OR starts_with(c, '(+') OR starts_with(d, '00') THEN length(d) >= 8
  WHEN label THEN true
  WHEN nsn IS NOT NULL AND length(d) > 10 AND nsn[1] <> '0' AND len(groups) >= 2 THEN true
  ELSE regexp_matches(c, {_full(fixed.RESIDUAL_SHAPES)}) END AS ok
  FROM g6 WHERE NOT regexp_matches(pre, {quoted(fixed.ID_LABEL)}) AND length({_digits('run')}) >= 7)"""


@query(f"WITH {WINDOWS} SELECT doc_id, base, i, j, start, \"end\", ok FROM windows")
def r05_r07_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of every run with its verdict."""
    return detect.residual_windows(table(spark, sf_dir, "documents", "doc_id", "text"))


@query(
    f"""WITH RECURSIVE {WINDOWS}, best AS (SELECT doc_id, base, i, max(j) AS j FROM windows WHERE ok GROUP BY doc_id, base, i),
walk AS (SELECT doc_id, base, min(i) AS i FROM best GROUP BY doc_id, base
  UNION ALL SELECT w.doc_id, w.base, (SELECT min(n.i) FROM best n WHERE n.doc_id = w.doc_id AND n.base = w.base AND n.i > b.j)
  FROM walk w JOIN best b ON b.doc_id = w.doc_id AND b.base = w.base AND b.i = w.i WHERE w.i IS NOT NULL)
SELECT v.doc_id, v.start, v."end" FROM walk w JOIN best b ON b.doc_id = w.doc_id AND b.base = w.base AND b.i = w.i
JOIN windows v ON v.doc_id = b.doc_id AND v.base = b.base AND v.i = b.i AND v.j = b.j"""
)
def r08_scan_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.explode(phones.scan_phones(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.end")


#: The loose shape without look-around, which RE2 lacks: its greedy ends stand where the look-around wants them.
_LOOSE = quoted(re.sub(r"\(\?<?![^)]*\)", "", fixed.LOOSE_EMAIL))
_TLD = "lower(string_split(string_split(s, '@')[2], '.')[-1])"


def address_sql(value: str = "value") -> str:
    """The canonical address in a value, or null, of rows with ``s``: the value with its signs spelled."""
    return f"""CASE WHEN len(string_split(s, '@')) <> 2 OR string_split(s, '@')[1] = '' OR len(string_split(string_split(s, '@')[2], '.')) < 2
  OR list_contains(string_split(string_split(s, '@')[2], '.'), '') OR NOT regexp_matches({_TLD}, '^\\p{{L}}{{2,24}}\\z')
  OR {_TLD} IN ({", ".join(quoted(x) for x in fixed.FILE_EXTENSIONS)}) OR (regexp_matches({value}, '\\s') AND {_TLD} NOT IN ({", ".join(quoted(x) for x in fixed.KNOWN_TLDS)})) THEN NULL ELSE s END"""


def spelled_sql(value: str = "value") -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({value}, {quoted(fixed.AT_TOKEN)}, '@', 'g'), {quoted(fixed.DOT_TOKEN)}, '.', 'g'), '[ \\t]+', '', 'g')"


#: Addresses of both shapes that are some, then greedily those that overlap no earlier one: e_walk(doc_id, start, stop).
EMAIL_WALK = f"""{matches_sql('es', fixed.EMAIL)}, {matches_sql('el', fixed.LOOSE_EMAIL).replace(quoted(fixed.LOOSE_EMAIL), _LOOSE)},
e_all AS (SELECT DISTINCT doc_id, start, CAST(start + length(value) AS INTEGER) AS stop, value FROM (SELECT doc_id, start, value FROM es UNION ALL SELECT doc_id, start, value FROM el)),
e_good AS (SELECT doc_id, start, stop FROM (SELECT *, {spelled_sql()} AS s FROM e_all) WHERE {address_sql()} IS NOT NULL),
e_walk AS (SELECT doc_id, min(struct_pack(a := start, b := stop)) AS v FROM e_good GROUP BY doc_id
  UNION ALL SELECT w.doc_id, (SELECT min(struct_pack(a := n.start, b := n.stop)) FROM e_good n WHERE n.doc_id = w.doc_id AND n.start >= w.v.b) FROM e_walk w WHERE w.v IS NOT NULL),
mails AS (SELECT doc_id, v.a AS start, v.b AS stop FROM e_walk WHERE v IS NOT NULL)"""

PHONE_WALK = f"""{WINDOWS}, best AS (SELECT doc_id, base, i, max(j) AS j FROM windows WHERE ok GROUP BY doc_id, base, i),
walk AS (SELECT doc_id, base, min(i) AS i FROM best GROUP BY doc_id, base
  UNION ALL SELECT w.doc_id, w.base, (SELECT min(n.i) FROM best n WHERE n.doc_id = w.doc_id AND n.base = w.base AND n.i > b.j)
  FROM walk w JOIN best b ON b.doc_id = w.doc_id AND b.base = w.base AND b.i = w.i WHERE w.i IS NOT NULL),
numbers AS (SELECT v.doc_id, v.start, v."end" AS stop FROM walk w JOIN best b ON b.doc_id = w.doc_id AND b.base = w.base AND b.i = w.i
JOIN windows v ON v.doc_id = b.doc_id AND v.base = b.base AND v.i = b.i AND v.j = b.j)"""

RESIDUAL = f"""{EMAIL_WALK}, {PHONE_WALK}, residual AS (SELECT doc_id, start, stop, 'email' AS kind FROM mails UNION ALL
SELECT doc_id, start, stop, 'phone' FROM numbers n WHERE NOT EXISTS (SELECT 1 FROM mails m WHERE m.doc_id = n.doc_id AND m.start < n.stop AND n.start < m.stop))"""


@query(f"WITH {matches_sql('m', fixed.LOOSE_EMAIL).replace(quoted(fixed.LOOSE_EMAIL), _LOOSE)} SELECT doc_id, start, CAST(start + length(value) AS INTEGER) AS \"end\", value FROM m")
def r09_loose_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter(F.col("text").rlike(r"(?i)@|[(\[]\s*at"))
    rows = docs.select("doc_id", F.explode(spans(F.col("text"), fixed.LOOSE_EMAIL)).alias("s"))
    return rows.select("doc_id", "s.start", "s.end", "s.value")


@query(f"WITH {matches_sql('m', fixed.EMAIL)}, n AS (SELECT doc_id, ord, value, {spelled_sql()} AS s FROM m) SELECT doc_id, ord, value, {address_sql()} AS address FROM n")
def r10_normalize_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter(F.col("text").contains("@"))
    rows = docs.select("doc_id", F.posexplode(emails.find_emails(F.col("text"))).alias("ord", "value"))
    return rows.select("doc_id", "ord", "value", emails.normalize_email(F.col("value")).alias("address"))


@query(f'WITH RECURSIVE {EMAIL_WALK} SELECT doc_id, start, stop AS "end" FROM mails')
def r11_scan_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.explode(emails.scan_emails(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.end")


@query(f'WITH RECURSIVE {RESIDUAL} SELECT doc_id, start, stop AS "end", kind FROM residual')
def r12_scan_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.residual_spans(table(spark, sf_dir, "documents", "doc_id", "text"))


LINES_SQL = f"""{WORDS_SQL}, lines AS (SELECT conv_id, block, line_no, string_agg(word, ' ' ORDER BY x0) AS text, CAST(count(*) AS BIGINT) AS n_words FROM words GROUP BY conv_id, block, line_no)"""


@query(f"WITH {LINES_SQL} SELECT conv_id, block, line_no, text, n_words FROM lines")
def r13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.lines(words(spark, sf_dir)).select("conv_id", "block", "line_no", "text", F.size("words").cast("long").alias("n_words"))


@query(
    f"""WITH {CARDS_SQL} SELECT conv_id, CAST(0 AS INTEGER) AS block, CAST(0 AS INTEGER) AS line_no, 'phone' AS kind, CAST(5.0 * (length(l0) - 10) AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(5.0 * length(l0) AS DOUBLE) AS x1, CAST(10 AS DOUBLE) AS y1 FROM cards
UNION ALL SELECT conv_id, 0, 1, 'email', 60.0, 12.0, 5.0 * (length(l1) - 11), 22.0 FROM cards UNION ALL SELECT conv_id, 0, 3, 'email', 0.0, 36.0, 5.0 * length(l3), 46.0 FROM cards"""
)
def r14_span_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.residual_boxes(cards(spark, sf_dir))


@query(
    """WITH hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS uri FROM pages)
SELECT page_id, uri FROM hrefs WHERE regexp_matches(lower(trim(uri)), '^(?:mailto|tel|callto|sms|fax|whatsapp):')"""
)
def r15_contact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose scheme says that they are contact details."""
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("uri"))
    return links.filter(detect.has_contact_scheme(F.col("uri")))


@query(
    f"""WITH RECURSIVE hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS uri FROM pages),
documents AS (SELECT row_number() OVER (ORDER BY uri) AS doc_id, uri AS text FROM (SELECT DISTINCT uri FROM hrefs)), {RESIDUAL}
SELECT h.page_id, h.uri FROM hrefs h JOIN documents d ON d.text = h.uri
WHERE NOT regexp_matches(lower(trim(h.uri)), '^(?:mailto|tel|callto|sms|fax|whatsapp):') AND NOT EXISTS (SELECT 1 FROM residual r WHERE r.doc_id = d.doc_id)"""
)
def r15_scrubbed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("uri"))
    return links.filter(~detect.is_contact_link(F.col("uri")))


@query(
    f"""WITH RECURSIVE {RESIDUAL} SELECT doc_id, source AS author, lang AS subject, CASE WHEN EXISTS (SELECT 1 FROM residual r WHERE r.doc_id = d.doc_id) THEN '' ELSE text END AS title FROM documents d"""
)
def r16_scrubbed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text")
    return detect.scrub_metadata(docs.select("doc_id", F.col("source").alias("author"), F.col("lang").alias("subject"), F.col("text").alias("title")), ["title", "author", "subject"])


#: Equivalent digit strings, as in ``functions.phones.equivalent``.
EQUIVALENT_SQL = """length(p.short) >= 7 AND length(p.long) <= 15 AND length(p.long) - length(p.short) <= 3 AND ends_with(p.long, p.short)
  AND (length(p.long) = length(p.short) OR starts_with(p.long, '0') OR length(p.short) >= 10)"""

#: Places of what the first pass finds, joined with the second pass's spans; what overlaps is one region.
REGIONS = f"""{ONE_PASS}, {RESIDUAL},
known AS (SELECT DISTINCT doc_id, {_digits('value')} AS d FROM phones WHERE ok),
pairs AS (SELECT u.doc_id, u.base AS start, u.base + length(u.run) AS stop, CASE WHEN length(u.d) > length(k.d) THEN k.d ELSE u.d END AS short, CASE WHEN length(u.d) > length(k.d) THEN u.d ELSE k.d END AS long
  FROM (SELECT *, {_digits('run')} AS d FROM runs WHERE NOT regexp_matches(pre, {quoted(fixed.ID_LABEL)})) u JOIN known k ON k.doc_id = u.doc_id),
located AS (SELECT p.doc_id, p.start, p.stop FROM pairs p WHERE {EQUIVALENT_SQL} UNION SELECT doc_id, start, start + length(value) FROM es),
every AS (SELECT doc_id, start, stop FROM located UNION SELECT doc_id, start, stop FROM residual),
marked AS (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS first FROM every),
islands AS (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY start, stop) AS region FROM marked),
regions AS (SELECT doc_id, region, min(start) AS start, max(stop) AS stop FROM islands GROUP BY doc_id, region)"""


@query(
    f"""WITH RECURSIVE {REGIONS}, kept AS (SELECT r.doc_id, r.start, r.stop, substr(d.text, CAST(coalesce(lag(r.stop) OVER o, 0) AS BIGINT) + 1, CAST(r.start - coalesce(lag(r.stop) OVER o, 0) AS BIGINT)) AS part
  FROM regions r JOIN documents d ON d.doc_id = r.doc_id WINDOW o AS (PARTITION BY r.doc_id ORDER BY r.start)),
cut AS (SELECT doc_id, string_agg(part, '' ORDER BY start) AS head, max(stop) AS stop, count(*) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN c.n IS NULL THEN d.text ELSE c.head || substr(d.text, CAST(c.stop AS BIGINT) + 1) END AS masked, CAST(coalesce(c.n, 0) AS INTEGER) AS regions FROM documents d LEFT JOIN cut c ON c.doc_id = d.doc_id"""
)
def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every document with what either pass finds cut out, and how many regions went."""
    return detect.mask(table(spark, sf_dir, "documents", "doc_id", "text"))


#: What is put under each document: (line, value that must go, value that must stay, whether the first pass finds it).
#: D is a mobile number and U a name, both of the document's own.
PLANTED = (
    ("Mobile: D", "D", None, True),
    ("write to U@example.com.", "U@example.com", None, True),
    ("91 D", "D", None, False),
    ("U (at) example (dot) com", "U (at) example (dot) com", None, False),
    ("Order Number: D", None, "D", True),
    ("from 2017 - 2021 here", None, "2017 - 2021", True),
    ("+91-D", "D", None, True),
    ("ISBN 978-3-16-148410-0", None, "978-3-16-148410-0", True),
)


@query(
    f"""WITH d AS (SELECT coalesce(lang, '') AS grp, doc_id % {len(PLANTED)} AS k FROM documents), p AS (SELECT unnest(['both', 'first']) AS passes),
n AS (SELECT grp, passes, count(*) FILTER (WHERE k IN ({", ".join(str(k) for k, x in enumerate(PLANTED) if x[1])})) AS positives, count(*) FILTER (WHERE k IN ({", ".join(str(k) for k, x in enumerate(PLANTED) if x[2])})) AS negatives,
  count(*) FILTER (WHERE passes = 'first' AND k IN ({", ".join(str(k) for k, x in enumerate(PLANTED) if not x[3])})) AS leaks FROM d, p GROUP BY grp, passes)
SELECT grp, passes, positives, negatives, leaks, CAST(0 AS BIGINT) AS over_masked, 1 - leaks / (positives + negatives) AS accuracy, CASE WHEN positives > 0 THEN 1 - leaks / positives END AS recall, CASE WHEN negatives > 0 THEN 1.0 END AS specificity FROM n"""
)
def a10_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by language against a truth that is given: a line under each document holds a value that must go, or one that
    must stay. With both passes nothing leaks; the first alone leaves what only the second can find."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    number = F.concat(F.lit("98"), F.lpad(((F.col("doc_id") * 7 + 1234567) % 100000000).cast("string"), 8, "0"))
    own = lambda t: F.lit(None).cast("string") if t is None else F.replace(F.replace(F.lit(t), F.lit("D"), number), F.lit("U"), F.concat(F.lit("u"), F.col("doc_id").cast("string")))
    kind = F.pmod(F.col("doc_id"), F.lit(len(PLANTED)))
    pick = lambda i: reduce(lambda e, k: F.when(kind == k, own(PLANTED[k][i])).otherwise(e), range(len(PLANTED)), F.lit(None).cast("string"))
    planted = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("grp"), F.concat_ws("\n", "text", pick(0)).alias("text"), F.array_compact(F.array(pick(1))).alias("must_mask"), F.array_compact(F.array(pick(2))).alias("must_survive"))
    return detect.score(planted)
