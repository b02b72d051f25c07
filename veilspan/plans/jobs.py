"""Streaming and orchestration queries, driven to their end over the tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks, template
from ..sources.records import CONTACTS_SQL, ITEMS_SQL, contacts, items
from ..sources.tables import table
from ..streaming import jobs, requests
from ..streaming.jobs import retried
from .registry import Catalog

CATALOG = Catalog()
query = CATALOG.query


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/veilspan-jobs"
    return f"{base.rstrip('/')}/jobs-{uuid.uuid4().hex}"


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return talk.select(
        (F.col("conv_id") % 50).cast("string").alias("job_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("item_id"),
        F.when(F.col("turn") != 3, F.col("text")).alias("text"), F.lit(None).cast("array<string>").alias("mask_strings"),
        F.lit("").alias("watermark"), F.lit("all").alias("batch_watermark"), F.current_timestamp().alias("submitted"),
    )


_PROGRESS = """SELECT CAST(conv_id % 50 AS VARCHAR) AS job_id, count(*) AS total, count(*) FILTER (WHERE turn <> 3 AND length(text) > 0) AS succeeded, count(*) FILTER (WHERE turn = 3 OR length(text) = 0) AS failed,
  CAST(0 AS BIGINT) AS pending, 'done' AS state FROM conversations GROUP BY 1"""


@query(_PROGRESS)
def q01_q03_q09_worked_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S17, Q1, Q3, Q6, Q9: submit every turn as an item, work the queue to its end, and report each job."""
    folder = _folder(spark)
    batch = _batch(spark, sf_dir)
    jobs.submit(batch, f"{folder}/queue")
    jobs.run(jobs.queue(spark, f"{folder}/queue"), f"{folder}/results", f"{folder}/checkpoint").awaitTermination()
    totals = batch.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    return jobs.progress(jobs.results(spark, f"{folder}/results"), totals).select("job_id", "total", "succeeded", "failed", "pending", "state")


@query("SELECT conv_id * 100 + turn AS item_id, CASE WHEN turn = 3 OR length(text) = 0 THEN 'error' ELSE 'ok' END AS status FROM conversations")
def q06_error_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.process(_batch(spark, sf_dir)).select("item_id", "status")


@query(f"WITH {ITEMS_SQL} SELECT job_id, count(*) > 60 AS queued FROM items GROUP BY job_id")
def q05_hand_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("job_id").agg(jobs.to_queue(F.count(F.lit(1)), 60, F.lit(True)).alias("queued"))


@query(f"WITH {ITEMS_SQL} SELECT item_id FROM items WHERE ts > (SELECT max(ts) FROM items) - INTERVAL 1 HOUR ORDER BY item_id LIMIT greatest(0, 10 - (SELECT count(*) FROM items WHERE ts > (SELECT max(ts) FROM items) - INTERVAL 900 SECOND))")
def q02_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest item's time is now; items of the last quarter of an hour hold leases, those of the last hour wait."""
    rows = items(spark, sf_dir)
    now = F.lit(rows.agg(F.max("ts")).first()[0])
    waiting = rows.filter(F.col("ts") > now - F.expr("INTERVAL 1 HOUR")).withColumnRenamed("item_id", "seq")
    return jobs.admitted(rows.withColumnRenamed("ts", "started_at"), waiting, now).select(F.col("seq").alias("item_id"))


@query("SELECT doc_id, 'masked_' || CAST(doc_id AS VARCHAR) AS title FROM documents")
def s18_masked_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import detect

    path = _folder(spark)
    sinks.masked_copies(detect.mask(table(spark, sf_dir, "documents", "doc_id", "text")), path)
    return spark.read.parquet(path).select("doc_id", "title")


@query("SELECT p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' END AS kind FROM part WHERE p_partkey % 3 < 2")
def s19_watermark_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    body = F.when(k == 0, F.unhex(F.lit("89504E470D0A1A0A00"))).when(k == 1, F.unhex(F.lit("FFD8FFE000"))).otherwise(F.lit(b""))
    good, _ = sinks.accepted_watermarks(table(spark, sf_dir, "part", "p_partkey").select(F.col("p_partkey").alias("name"), body.alias("body")))
    return good.select("name", "kind")


@query("SELECT p_partkey, p_name AS word, CAST(p_size AS DOUBLE) AS x0, CAST(p_size + 5 AS DOUBLE) AS x1, CAST(90 AS DOUBLE) AS conf FROM part WHERE p_partkey % 2 = 0")
def s22_ocr_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines for each part: a word, and one below the least confidence."""
    from ..operators import layout

    size = F.col("p_size").cast("string")
    line = lambda conf, word: F.concat_ws("\t", F.lit("5\t1\t1\t1\t1\t1"), size, F.lit("7\t5\t9"), conf, word)
    tsv = F.concat_ws("\n", F.lit("level\tpage"), line(F.when(F.col("p_partkey") % 2 == 0, "90").otherwise("19"), F.col("p_name")), line(F.lit("-1"), F.lit("x")), F.lit("4\t1"))
    rows = layout.ocr_words(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), tsv.alias("tsv")))
    return rows.select(F.col("doc_id").alias("p_partkey"), "word", "x0", "x1", "conf")


@query(
    """SELECT p_partkey AS contact_id, 'Summary' || chr(10) || p_type || ' with ' || CAST(p_size AS VARCHAR) || CASE WHEN p_size = 1 THEN ' year' ELSE ' years' END || ' of experience, currently working at ' || p_brand || '. Core skills include ' || p_name || '.'
  || chr(10) || chr(10) || 'Skills' || chr(10) || p_name || chr(10) || chr(10) || 'Other skills' || chr(10) || p_type || chr(10) || chr(10) || 'Details' || chr(10) || 'Date of birth: 07 June 2001 | Languages: en' AS document FROM part"""
)
def s23_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return template.render(p.select(F.col("p_partkey").alias("contact_id"), F.col("p_type").alias("designation"), F.col("p_brand").alias("company"), F.col("p_size").cast("string").alias("experience"),
                                    F.col("p_name").alias("skills"), F.col("p_type").alias("other_skills"), F.lit("").alias("qualification"), F.lit("2001-06-07").alias("born"), F.lit("en").alias("languages")))


@query(f"WITH {CONTACTS_SQL} SELECT contact_id, name FROM contacts WHERE contact_id % 5 = 0")
def f23_faded_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts whose pixel (grey 255 for every fifth) is knocked out as background."""
    from ..operators.pixels import faded

    k = F.col("contact_id")
    grey = F.when(k % 5 == 0, "FF").otherwise("10")
    rows = contacts(spark, sf_dir).select("contact_id", "name", F.unhex(F.concat(grey, grey, grey)).alias("rgb"))
    out = rows.withColumn("rgba", faded(0.16)("rgb"))
    return out.filter(F.hex(F.substring("rgba", 4, 1)) == "00").select("contact_id", "name")


@query(
    """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS calls,
  CASE s_suppkey % 5 WHEN 1 THEN 1.5 WHEN 2 THEN 4.5 ELSE 0.0 END AS waited, s_suppkey % 5 NOT IN (2, 3) AS ok FROM supplier"""
)
def q07_f16_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for every supplier, by its number: right at once, busy once, busy for good, refused, or with a session that
    had expired."""
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key in batch["s_suppkey"].tolist():
                calls, waits = [], []

                def once(fresh: bool, kind=key % 5, calls=calls) -> None:
                    calls.append(fresh)
                    if (kind == 1 and len(calls) == 1) or kind == 2:
                        raise ValueError("Error code: 503")
                    if kind == 3:
                        raise ValueError("malformed id")
                    if kind == 4 and not fresh:
                        raise PermissionError("session")

                try:
                    retried(once, sleep=waits.append, transient=lambda e: "503" in str(e), expired=lambda e: isinstance(e, PermissionError))
                    ok = True
                except ValueError:
                    ok = False
                rows.append((key, len(calls), float(sum(waits)), ok))
            yield pd.DataFrame(rows, columns=["s_suppkey", "calls", "waited", "ok"])

    return table(spark, sf_dir, "supplier", "s_suppkey").mapInPandas(call, "s_suppkey long, calls int, waited double, ok boolean")


@query("SELECT CAST(user_id AS VARCHAR) AS job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS idx, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'all' END AS watermark FROM events")
def d13_batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One json request for each user, parsed back to its items."""
    k = F.col("event_id")
    item = F.struct(k.alias("n"), F.struct(k.cast("string").alias("job_applicant_id"), F.when(k % 2 == 0, "own").alias("watermark_base64")).alias("i"))
    rows = table(spark, sf_dir, "events", "user_id", "event_id").groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    body = F.to_json(F.struct(F.col("all.i").alias("items"), F.lit("all").alias("watermark_base64")))
    items_, _ = requests.parse(rows.select(F.col("user_id").cast("string").alias("job_id"), body.alias("json")))
    return items_.select("job_id", "idx", "id", "watermark")
