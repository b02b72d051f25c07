"""Record relations: contacts, applicants, files, registry rows, job items and page words.

The engine reads them from wherever they are kept; these views derive them from the generic tables, so that every
query has data at every scale. Each view has its SQL twin, which the oracles use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .tables import table

CONTACTS_SQL = """contacts AS (
  SELECT c_custkey AS contact_id, c_name AS name, c_nationkey AS nation_id, c_mktsegment AS segment, c_acctbal AS balance,
    CASE c_custkey % 6
      WHEN 0 THEN '+91 ' || substr(d, 1, 5) || ' ' || substr(d, 6, 5)
      WHEN 1 THEN d WHEN 2 THEN d || '    8' || lpad(CAST(c_custkey + 7 AS VARCHAR), 9, '0')
      WHEN 3 THEN d || ' (A)' WHEN 4 THEN '0' || d END AS phone,
    CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email,
    CASE WHEN c_custkey % 4 = 0 THEN d END AS mobile
  FROM (SELECT *, '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS d FROM customer))"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    d = F.concat(F.lit("9"), F.lpad(key.cast("string"), 9, "0"))
    phone = (
        F.when(key % 6 == 0, F.concat(F.lit("+91 "), d.substr(1, 5), F.lit(" "), d.substr(6, 5)))
        .when(key % 6 == 1, d)
        .when(key % 6 == 2, F.concat(d, F.lit("    8"), F.lpad((key + 7).cast("string"), 9, "0")))
        .when(key % 6 == 3, F.concat(d, F.lit(" (A)")))
        .when(key % 6 == 4, F.concat(F.lit("0"), d))
    )
    email = F.when(key % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")))
    return table(spark, sf_dir, "customer").select(
        key.alias("contact_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"), phone.alias("phone"), email.alias("email"), F.when(key % 4 == 0, d).alias("mobile"),
    )


APPLICANTS_SQL = """applicants AS (
  SELECT o_orderkey AS applicant_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS contact_id,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 97 END AS account_id, o_orderdate AS created_at, o_orderstatus AS status,
    'JA-' || CAST(o_orderkey AS VARCHAR) AS name
  FROM orders)"""


def applicants(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("applicant_id"), F.when(key % 11 != 0, F.col("o_custkey")).alias("contact_id"), F.when(key % 13 != 0, key % 97).alias("account_id"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("JA-"), key.cast("string")).alias("name"),
    )


FILES_SQL = """files AS (
  SELECT l_orderkey AS applicant_id, l_linenumber AS file_no, l_shipdate AS created_at,
    CASE WHEN l_linenumber % 2 = 0 THEN 'attachment' ELSE 'file' END AS storage,
    CASE WHEN l_partkey % 3 = 0 THEN 'contact' ELSE 'applicant' END AS parent,
    CASE WHEN l_suppkey % 5 = 0 THEN 'masked_' ELSE 'resume_' END || CAST(l_partkey AS VARCHAR) ||
      CASE l_returnflag WHEN 'A' THEN '.PDF' WHEN 'R' THEN '.docx' ELSE CASE WHEN l_linestatus = 'O' THEN '.doc' ELSE '.png' END END AS name
  FROM lineitem)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("l_returnflag") == "A", ".PDF").when(F.col("l_returnflag") == "R", ".docx").when(F.col("l_linestatus") == "O", ".doc").otherwise(".png")
    lead = F.when(F.col("l_suppkey") % 5 == 0, "masked_").otherwise("resume_")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("applicant_id"), F.col("l_linenumber").alias("file_no"), F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_linenumber") % 2 == 0, "attachment").otherwise("file").alias("storage"),
        F.when(F.col("l_partkey") % 3 == 0, "contact").otherwise("applicant").alias("parent"),
        F.concat(lead, F.col("l_partkey").cast("string"), ext).alias("name"),
    )


REGISTRY_SQL = """env_orgs AS (SELECT lower(n_name) AS client_key, 'env-' || n_name AS client_id FROM nation WHERE n_nationkey < 15),
db_orgs AS (SELECT lower(n_name) AS client_key, 'db-' || n_name AS client_id FROM nation WHERE n_nationkey >= 10)"""


def registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.lower("n_name").alias("client_key"), F.concat(F.lit(name), F.col("n_name")).alias("client_id"))

    return side(nation.filter("n_nationkey < 15"), "env-"), side(nation.filter("n_nationkey >= 10"), "db-")


ITEMS_SQL = """items AS (
  SELECT user_id AS job_id, event_id AS item_id, ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, event_type, value,
    CASE event_type WHEN 'error' THEN 'Error code: 503 for ' || CAST(event_id AS VARCHAR) WHEN 'signup' THEN 'invalid_grant: server is busy' ELSE 'malformed id' END AS message
  FROM events)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    message = (
        F.when(kind == "error", F.concat(F.lit("Error code: 503 for "), F.col("event_id").cast("string")))
        .when(kind == "signup", "invalid_grant: server is busy")
        .otherwise("malformed id")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("item_id"), "ts", F.when(kind == "error", "error").otherwise("ok").alias("status"),
        "event_type", "value", message.alias("message"),
    )


#: A page of words: lines of a turn's text in a fixed pitch, 5 points a character and 12 a line.
WORDS_SQL = """words0 AS (
  SELECT conv_id, turn, line_no, line, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS word_no
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM conversations)),
words1 AS (
  SELECT *, sum(length(word) + 1) OVER (PARTITION BY conv_id, turn, line_no ORDER BY word_no) - length(word) - 1 AS pos FROM words0),
words AS (
  SELECT conv_id, CAST(turn AS INTEGER) AS block, CAST(line_no AS INTEGER) AS line_no, CAST(word_no AS INTEGER) AS word_no, word,
    CAST(5.0 * pos AS DOUBLE) AS x0, CAST(5.0 * (pos + length(word)) AS DOUBLE) AS x1, CAST(12.0 * line_no AS DOUBLE) AS y0, CAST(12.0 * line_no + 10.0 AS DOUBLE) AS y1
  FROM words1 WHERE word <> '')"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(
        "conv_id", F.col("turn").cast("int").alias("block"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    )
    return words_of_lines(lines)


def words_of_lines(lines: DataFrame) -> DataFrame:
    """Words with boxes from (conv_id, block, line_no, line). Offsets come from a fold inside the row: no shuffle."""
    start = F.array().cast("array<int>")
    offsets = F.aggregate(
        F.split("line", " ", -1), F.struct(F.lit(0).alias("at"), start.alias("out")),
        lambda a, w: F.struct((a["at"] + F.length(w) + 1).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"],
    )
    rows = lines.select("conv_id", "block", "line_no", F.posexplode(F.arrays_zip(F.split("line", " ", -1).alias("word"), offsets.alias("at"))).alias("word_no", "w"))
    at, y = F.col("w.at"), 12.0 * F.col("line_no")
    return rows.filter("w.word <> ''").select(
        "conv_id", "block", "line_no", "word_no", F.col("w.word").alias("word"), (5.0 * at).alias("x0"), (5.0 * (at + F.length("w.word"))).alias("x1"), y.alias("y0"), (y + 10.0).alias("y1")
    )


#: Four lines about each contact: a labelled number, an address with a label behind it, a label, and an address under it.
CARDS_SQL = """cards AS (SELECT c_custkey AS conv_id, 'Nationality Indian Phone number: ' || '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS l0,
  'Reach me at u' || CAST(c_custkey AS VARCHAR) || '@example.com (official)' AS l1, 'Email id:' AS l2, 'x' || CAST(c_custkey AS VARCHAR) || '@example.com' AS l3 FROM customer)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of those lines, with boxes."""
    key = F.col("c_custkey").cast("string")
    lines = F.array(
        F.concat(F.lit("Nationality Indian Phone number: 9"), F.lpad(key, 9, "0")), F.concat(F.lit("Reach me at u"), key, F.lit("@example.com (official)")),
        F.lit("Email id:"), F.concat(F.lit("x"), key, F.lit("@example.com")),
    )
    rows = table(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("conv_id"), F.lit(0).alias("block"), F.posexplode(lines).alias("line_no", "line"))
    return words_of_lines(rows)


def reading_order() -> WindowSpec:
    return Window.partitionBy("conv_id", "block", "line_no").orderBy("x0")
