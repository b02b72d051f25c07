"""Known-value queries: normalisation, equivalence, placement and snapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, phones, scalars
from ..operators import detect, known
from ..sources.records import CONTACTS_SQL, contacts, words_of_lines
from ..sources.tables import table
from .detection import EQUIVALENT_SQL, ONE_PASS, _digits
from .registry import Catalog, quoted

CATALOG = Catalog()
query = CATALOG.query

VALUES_SQL = f"""{CONTACTS_SQL}, vals AS (
  SELECT contact_id, 0 AS k, phone AS value FROM contacts UNION ALL SELECT contact_id, 1, email FROM contacts UNION ALL SELECT contact_id, 2, mobile FROM contacts
  UNION ALL SELECT contact_id, 3, name FROM contacts)"""

_PH = quoted(fixed.PHONE_STRING)


def _valid(x: str) -> str:
    return f"length({_digits(x)}) BETWEEN 7 AND 15"


@query(
    f"""WITH {VALUES_SQL} SELECT contact_id, value, CASE WHEN regexp_matches(trim(value), {quoted('^' + fixed.EMAIL + chr(92) + 'z')}) THEN 'email'
  WHEN regexp_matches(trim(value), {_PH}) AND {_valid('value')} THEN 'phone' ELSE 'name' END AS kind FROM vals WHERE value IS NOT NULL"""
)
def k01_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contacts(spark, sf_dir).select("contact_id", F.explode(F.array("phone", "email", "mobile", "name")).alias("value")).filter("value is not null")
    return rows.withColumn("kind", phones.classify(F.col("value")))


SPLIT_SQL = f"""parts AS (SELECT contact_id, k, v, unnest(p) AS part, generate_subscripts(p, 1) AS n FROM (
    SELECT contact_id, k, trim(value) AS v, list_filter(list_transform(string_split_regex(regexp_replace(trim(value), '\\s+\\+', '|+', 'g'), '\\s{{2,}}|[,;/|\\n\\r]+'), lambda x: trim(x)), lambda x: x <> '') AS p
    FROM vals WHERE value IS NOT NULL AND trim(value) <> '')),
numbers AS (SELECT contact_id, k, n, v, unnest(CASE WHEN {_valid('part')} AND regexp_matches(part, {_PH}) THEN [part]
    ELSE list_filter(regexp_extract_all(part, {quoted(fixed.PHONE_RUN)}), lambda r: {_valid('r')}) END) AS value FROM parts
    WHERE NOT (length({_digits('v')}) <= 15 AND regexp_matches(v, {_PH}))),
every AS (SELECT contact_id, k, 0 AS n, trim(value) AS value FROM vals WHERE value IS NOT NULL AND trim(value) <> '' AND NOT EXISTS (SELECT 1 FROM numbers x WHERE x.contact_id = vals.contact_id AND x.k = vals.k)
  UNION ALL SELECT contact_id, k, n, value FROM numbers)"""


@query(f"WITH {VALUES_SQL}, {SPLIT_SQL} SELECT contact_id, value, CAST(min(k) AS INTEGER) AS field FROM every WHERE k < 3 GROUP BY contact_id, value")
def k02_k05_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 to K5: every value to look for, each once, with the first field that holds it."""
    rows = contacts(spark, sf_dir).select("contact_id", F.posexplode(F.array("phone", "email", "mobile")).alias("k", "v")).filter("v is not null and trim(v) <> ''")
    parts = rows.select("contact_id", "k", F.explode(phones.expand(F.array("v"))).alias("value"))
    return parts.groupBy("contact_id", "value").agg(F.min("k").alias("field"))


@query(
    f"""WITH {CONTACTS_SQL}, v AS (SELECT contact_id, lpad(CAST(contact_id AS VARCHAR), 6, '9') AS a, '9' || lpad(CAST(contact_id AS VARCHAR), 9, '0') AS b, contact_id % 3 AS k FROM contacts)
SELECT contact_id, a || ' ' || b || CASE k WHEN 0 THEN '' WHEN 1 THEN ' 12' ELSE ' 2345678' END AS value, unnest(CASE k WHEN 0 THEN [b] WHEN 1 THEN [b || ' 12'] ELSE [b, '2345678'] END) AS number FROM v"""
)
def k03_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized fields of six and ten digits, and of what may stand behind them."""
    key = F.col("contact_id")
    more = F.when(key % 3 == 0, "").when(key % 3 == 1, " 12").otherwise(" 2345678")
    value = F.concat(F.lpad(key.cast("string"), 6, "9"), F.lit(" 9"), F.lpad(key.cast("string"), 9, "0"), more)
    rows = contacts(spark, sf_dir).select("contact_id", value.alias("value"))
    return rows.select("contact_id", "value", F.explode(phones.regroup(F.col("value"))).alias("number"))


@query(
    f"""WITH {CONTACTS_SQL}, p AS (SELECT contact_id AS a_id, {_digits('phone')} AS a FROM contacts WHERE phone IS NOT NULL), m AS (SELECT contact_id AS b_id, mobile AS b FROM contacts WHERE mobile IS NOT NULL),
j AS (SELECT *, CASE WHEN length(a) > length(b) THEN b ELSE a END AS s, CASE WHEN length(a) > length(b) THEN a ELSE b END AS l FROM p JOIN m ON right(a, 7) = right(b, 7))
SELECT a_id, b_id, a, b FROM j WHERE CASE WHEN length(s) < 7 OR length(l) > 15 OR length(l) - length(s) > 3 OR NOT ends_with(l, s) THEN false WHEN length(l) = length(s) THEN true
  WHEN starts_with(l, '0') THEN true ELSE length(s) >= 10 END"""
)
def k06_equivalent_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of two tables that are one: an equi-join on the last seven digits, then the rule."""
    people = contacts(spark, sf_dir)
    a = people.filter("phone is not null").select(F.col("contact_id").alias("a_id"), phones.digits(F.col("phone")).alias("a"))
    b = people.filter("mobile is not null").select(F.col("contact_id").alias("b_id"), F.col("mobile").alias("b"))
    met = a.withColumn("tail", F.right("a", F.lit(7))).join(b.withColumn("tail", F.right("b", F.lit(7))), "tail")
    return met.filter(phones.equivalent(F.col("a"), F.col("b"))).select("a_id", "b_id", "a", "b")


def _document_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter(F.col("text").rlike(detect.GATE))
    lines = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("block"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).filter(F.col("line").rlike(detect.GATE))
    return docs, words_of_lines(lines)


#: Lines of documents that may hold a contact detail, their words in a fixed pitch, and runs of words from each word on.
_LINES = f"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE regexp_matches(text, {quoted(detect.GATE)})),
w0 AS (SELECT doc_id, line_no, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS word_no FROM l0 WHERE regexp_matches(line, {quoted(detect.GATE)})),
w1 AS (SELECT *, sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no) - length(word) - 1 AS pos FROM w0),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY word_no) AS k FROM w1 WHERE word <> ''),
ws AS (SELECT doc_id, line_no, list(word ORDER BY k) AS held FROM w GROUP BY doc_id, line_no),
seq AS (SELECT a.doc_id, a.line_no, a.word_no AS i, b.word_no AS j, a.word, b.k - a.k + 1 AS n, array_to_string(s.held[1:a.k - 1], ' ') AS before, array_to_string(s.held[a.k:b.k], '') AS run,
  CAST(5.0 * a.pos AS DOUBLE) AS x0, CAST(12.0 * a.line_no AS DOUBLE) AS y0, CAST(5.0 * (b.pos + length(b.word)) AS DOUBLE) AS x1, CAST(12.0 * a.line_no + 10 AS DOUBLE) AS y1
  FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.line_no = a.line_no AND b.k BETWEEN a.k AND a.k + 5 JOIN ws s ON s.doc_id = a.doc_id AND s.line_no = a.line_no)"""


@query(
    f"""WITH {ONE_PASS}, {_LINES}, targets AS (SELECT DISTINCT doc_id, {_digits('value')} AS t FROM phones WHERE ok),
p AS (SELECT s.*, t.t, length(d.d) AS size, CASE WHEN length(d.d) > length(t.t) THEN t.t ELSE d.d END AS short, CASE WHEN length(d.d) > length(t.t) THEN d.d ELSE t.t END AS long
  FROM seq s JOIN targets t ON t.doc_id = s.doc_id, LATERAL (SELECT {_digits('s.run')} AS d) d WHERE regexp_matches(s.word, '\\p{{Nd}}') AND NOT regexp_matches(s.before, {quoted(fixed.ID_LABEL)}) AND length(t.t) >= 7)
SELECT doc_id AS conv_id, CAST(0 AS INTEGER) AS block, CAST(line_no AS INTEGER) AS line_no, '+' || t AS target, CAST(i AS INTEGER) AS i, CAST(min(j) AS INTEGER) AS j, min(x0) AS x0, min(y0) AS y0, min(x1) AS x1, min(y1) AS y1
FROM p WHERE size <= length(t) + {fixed.WINDOW_SLACK} AND {EQUIVALENT_SQL} GROUP BY doc_id, line_no, t, i"""
)
def k07_place_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, words = _document_words(spark, sf_dir)
    targets = detect.detect(docs).filter("kind = 'phone'").select(F.col("doc_id").alias("conv_id"), F.concat(F.lit("+"), phones.digits(F.col("value"))).alias("target"))
    return known.place_phones(words, targets, ["conv_id", "block", "line_no"], ["conv_id"])


@query(
    f"""WITH e AS (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, {quoted(fixed.EMAIL)}))) AS email FROM documents),
g AS (SELECT doc_id, email, string_split(lower(text), lower(email)) AS gaps FROM e), k AS (SELECT *, unnest(range(1, len(gaps))) AS k FROM g),
p AS (SELECT doc_id, email, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + (k - 1) * length(email) AS INTEGER) AS start FROM k)
SELECT doc_id, email, start, CAST(start + length(email) AS INTEGER) AS "end" FROM p"""
)
def k08_place_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter(F.col("text").contains("@"))
    rows = docs.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(fixed.EMAIL), F.lit(0)))).alias("email"))
    return rows.select("doc_id", "email", F.explode(known.literal_places(F.lower("text"), F.lower("email"))).alias("start")).withColumn("end", F.col("start") + F.length("email"))


@query(f"WITH {VALUES_SQL}, {SPLIT_SQL} SELECT CASE WHEN regexp_matches(value, {_PH}) THEN 'digits' WHEN contains(value, '@') THEN 'literal' ELSE 'none' END AS strategy, count(*) AS n FROM every GROUP BY 1")
def k09_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contacts(spark, sf_dir).select(F.explode(F.filter(F.array("phone", "email", "mobile", "name"), lambda v: v.isNotNull() & (F.trim(v) != ""))).alias("v"))
    kind = phones.classify(F.col("value"))
    strategy = F.when(kind == "phone", "digits").when(kind == "email", "literal").otherwise("none")
    return rows.select(F.explode(phones.split_phone_list(F.col("v"))).alias("value")).groupBy(strategy.alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {VALUES_SQL}, v AS (SELECT contact_id, value FROM vals WHERE value IS NOT NULL AND k < 3)
SELECT contact_id, 'email' AS kind, lower(trim(value)) AS value FROM v WHERE contains(value, '@')
UNION ALL SELECT contact_id, 'phone', right({_digits('part')}, 10) FROM (SELECT contact_id, unnest(string_split_regex(value, '[,/;|]')) AS part FROM v WHERE NOT contains(value, '@') AND length({_digits('value')}) >= 10)
WHERE length({_digits('part')}) >= 10"""
)
def k10_known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.filter(F.array("phone", "email", "mobile"), lambda v: v.isNotNull())
    rows = contacts(spark, sf_dir).select("contact_id", known.known_emails_and_phones(values).alias("k"))
    mails = rows.select("contact_id", F.lit("email").alias("kind"), F.explode("k.emails").alias("value"))
    return mails.unionByName(rows.select("contact_id", F.lit("phone").alias("kind"), F.explode("k.phones").alias("value")))


@query(
    """SELECT n_nationkey, n_name AS a, r_name AS b, CASE WHEN abs(length(n_name) - length(r_name)) > 3 THEN 4 ELSE levenshtein(n_name, r_name) END AS distance
FROM nation JOIN region ON n_regionkey = r_regionkey"""
)
def k11_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    met = n.join(r, n.n_regionkey == r.r_regionkey)
    return met.select("n_nationkey", F.col("n_name").alias("a"), F.col("r_name").alias("b"), known.capped_distance(F.col("n_name"), F.col("r_name")).cast("long").alias("distance"))


@query(
    f"""WITH {_LINES}, known AS (SELECT DISTINCT doc_id, 'x' || lower(unnest(regexp_extract_all(text, {quoted(fixed.EMAIL)}))) AS email FROM documents),
p AS (SELECT s.*, k.email, r.joined FROM seq s JOIN known k ON k.doc_id = s.doc_id, LATERAL (SELECT regexp_replace(lower(s.run), '^[.,;:()<>\\[\\]]+|[.,;:()<>\\[\\]]+$', '', 'g') AS joined) r WHERE s.n <= 3),
b AS (SELECT doc_id, line_no, email, min(struct_pack(i := i, j := j, x0 := x0, y0 := y0, x1 := x1, y1 := y1)) AS b FROM p WHERE joined <> email AND abs(length(joined) - length(email)) <= 2 AND levenshtein(joined, email) <= 2 GROUP BY doc_id, line_no, email)
SELECT doc_id AS conv_id, CAST(0 AS INTEGER) AS block, CAST(line_no AS INTEGER) AS line_no, email, CAST(b.i AS INTEGER) AS i, CAST(b.j AS INTEGER) AS j, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, CAST(100 AS DOUBLE) AS conf FROM b"""
)
def k12_snap_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings a character off: the known addresses are the texts' own with one letter more."""
    docs, words = _document_words(spark, sf_dir)
    mails = detect.detect(docs).filter("kind = 'email'").select(F.col("doc_id").alias("conv_id"), F.lower(F.concat(F.lit("x"), F.col("value"))).alias("email"))
    return known.snap_emails(words, mails, ["conv_id", "block", "line_no"], ["conv_id"])


@query(
    f"""WITH {CONTACTS_SQL}, s AS (SELECT contact_id, '1' || substr(mobile, 1, 9) || CAST((CAST(substr(mobile, 10, 1) AS INTEGER) + contact_id // 4) % 10 AS VARCHAR) || '77' AS stream, mobile FROM contacts WHERE mobile IS NOT NULL)
SELECT contact_id, CAST(w AS INTEGER) AS start FROM (SELECT *, unnest(range(0, length(stream) - 9)) AS w FROM s)
WHERE len(list_filter(range(1, 11), lambda i: substr(stream, CAST(w + i AS BIGINT), 1) <> substr(mobile, i, 1))) = 1"""
)
def k13_snap_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit streams that hold a known number with one digit misread (or none: then there is nothing to snap)."""
    rows = contacts(spark, sf_dir).filter("mobile is not null")
    last = F.pmod(F.substring("mobile", 10, 1).cast("int") + F.floor(F.col("contact_id") / 4), F.lit(10)).cast("string")
    stream = F.concat(F.lit("1"), F.substring("mobile", 1, 9), last, F.lit("77"))
    return rows.select("contact_id", F.explode(known.snap_phones(stream, F.col("mobile"))).alias("start"))


@query("SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), CAST(12 + o_orderkey % 8 AS INTEGER), 'a') AS id, o_orderkey % 8 BETWEEN 3 AND 6 AS safe FROM orders")
def k14_safe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders", "o_orderkey").withColumn("id", F.expr("lpad(cast(o_orderkey as string), cast(12 + o_orderkey % 8 as int), 'a')"))
    return rows.withColumn("safe", scalars.is_safe_id(F.col("id")))


@query(
    """SELECT conv_id, turn, list_aggregate(list_distinct(list_filter(string_split_regex(CASE turn % 4 WHEN 0 THEN text || ' aaaaabbbbbccccc' WHEN 1 THEN text WHEN 2 THEN '' ELSE '' END, '[\\s,;]+'),
  lambda p: regexp_matches(p, '^(?:[A-Za-z0-9]{15}|[A-Za-z0-9]{18})\\z'))), 'count') AS n_ids
FROM conversations"""
)
def k15_harvest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parameters: of names that may hold ids (two of them, or one), that say otherwise, and that say nothing."""
    names = F.when(F.col("turn") % 4 == 0, "RecordIds").when(F.col("turn") % 4 == 1, "profile").when(F.col("turn") % 4 == 2, "sfURL").otherwise("page")
    more = F.struct(F.when(F.col("turn") % 4 == 0, "ids").otherwise("user").alias("name"), F.lit("aaaaabbbbbccccc").alias("value"))
    ids = scalars.ids_of_parameters(F.array(F.struct(names.alias("name"), F.col("text").alias("value")), more))
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.when(ids == "", 0).otherwise(F.size(F.split(ids, ";"))).cast("long").alias("n_ids"))


@query("SELECT regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS shape, count(*) AS n FROM customer GROUP BY 1")
def k16_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", "c_name").groupBy(scalars.pii_shape(F.col("c_name")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
