"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, html_extract, langid, neardup, packing, secrets, shards, tokencounts, urlfilter
from .common import checked_small, materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.Index(_table(spark, sf_dir, "embeddings"), k=20).search(F.col("vec_id") % 20 == 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, each sent twice: all documents come in; those labelled toxic go; those labelled of low
    quality move to a source of their own, their white space revised to single blanks."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    toxic, low = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 0, F.lit(False))
    marks = materialise(marks.select(F.col("doc_id").alias("m_id"), toxic.alias("toxic"), low.alias("low")).filter("toxic or low"), "marks")
    own = F.col("doc_id") == F.col("m_id")
    # Counts meet the marks, not texts; of texts, only those to revise are looked for.
    before = tokencounts.counted(docs).join(checked_small(marks), own, "left").drop("m_id").fillna(False, ["toxic", "low"])
    before = materialise(before, "counted")
    revised = docs.join(checked_small(marks.filter("low and not toxic").select("m_id")), own, "left_semi")
    revised = revised.withColumn("text", F.regexp_replace("text", r"\s+", " ")).withColumn("source", F.concat(F.lit("low:"), "source"))
    batches = {
        "load": tokencounts.inserts(before),
        "takedown": tokencounts.deletes(before.filter("toxic")),
        "revision": tokencounts.revisions(before.filter("low and not toxic"), materialise(tokencounts.counted(revised), "counted")),
    }
    rollup = tokencounts.Rollup(spark)
    for name in (*batches, *batches):
        rollup.commit(name, batches[name])
    return rollup.totals()


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), out="text")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.identify(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(secrets.digest(base).cast("binary"), 256).alias("base_sha256"), secrets.digest(F.col("spans")).alias("spans"), "blob",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_nearest_neighbours": op2_nearest_neighbours,
        "op3_token_counts": op3_token_counts,
        "op4_html_extraction": op4_html_extraction,
        "op5_language_id": op5_language_id,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_sharding": op8_sharding,
        "op9_url_filters": op9_url_filters,
        "op10_secret_scans": op10_secret_scans,
    }


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs that share a shingle, exactly; components by following links to smaller ids.
OP7_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[ \\t-\\r]+'), lambda x: x <> '') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS s FROM w),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 100 * c >= 75 * (na + nb - c)),
walk AS (SELECT doc_id, doc_id AS near FROM sets UNION SELECT w.doc_id, l.b FROM walk w JOIN links l ON l.a = w.near),
least AS (SELECT doc_id, min(near) AS component_id FROM walk GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)"""


def _op10_sql() -> str:
    """Each rule's matches with their places: lengths of what lies between matches and of the matches, summed up."""
    parts = []
    for no, r in enumerate(secrets.RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT doc_id, {no} AS k, '{r.kind}' AS kind, {str(r.base).lower()} AS base, f[i] AS value, s[i] AS sized, {r.least} AS least,
  CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS f, regexp_extract_all(text, {p}, {r.group}) AS s, string_split_regex(text, {p}) AS g FROM documents WHERE regexp_matches(text, {p})))""")
    return f"""WITH found AS ({" UNION ALL ".join(parts)}), good AS (SELECT *, start + length(value) AS stop, kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(start + length(value) AS VARCHAR) AS name FROM found WHERE length(sized) >= least),
each AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(name, ',' ORDER BY start, k, stop) FILTER (WHERE base) AS b, string_agg(name, ',' ORDER BY start, k, stop) AS spans FROM good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans,
  sha256(coalesce(text, '')) AS blob FROM documents d LEFT JOIN each e ON e.doc_id = d.doc_id"""


#: The checksum byte by byte from its table; then running sums in the order of doc_id, checksum and size.
OP8_SQL = f"""WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size FROM documents),
v AS (SELECT doc_id, size, list_concat([4294967295::UBIGINT], list_transform(range(size - 1), lambda k: CAST((strpos('0123456789ABCDEF', h[2 * k + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * k + 2]) - 1 AS UBIGINT))) AS v FROM b),
s AS (SELECT doc_id, size, CAST(xor(list_reduce(v, lambda c, x: xor(c >> 8, t[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295) AS BIGINT) AS text_crc32 FROM v, tab),
r AS (SELECT *, CAST(sum(size) OVER o - size AS BIGINT) AS start_byte, row_number() OVER o AS "row", sum(size) OVER () AS whole FROM s WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, CAST(least({shards.SHARDS - 1}, ((2 * start_byte + size) * {shards.SHARDS}) // (2 * whole)) AS INTEGER) AS shard FROM r)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST("row" - min("row") OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, start_byte FROM d"""


def oracle_sql() -> dict[str, str]:
    return {"op7_minhash_near_dedup": OP7_SQL, "op8_sharding": OP8_SQL, "op10_secret_scans": _op10_sql()}
