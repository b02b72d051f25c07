"""Jobs as streams: items arrive in files, micro-batches mask them, progress is kept by job.

A batch that fails is run again by Spark from its checkpoint, so an item is handled at least once; results are keyed by
(job, item) and one row of each stays, which makes a replay harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..operators import detect

ITEM = "job_id string, item_id long, text string, mask_strings array<string>, watermark string, batch_watermark string, submitted timestamp"


def submit(items: DataFrame, folder: str) -> None:
    """Append items to the queue: each file of the folder is one arrival."""
    items.write.mode("append").json(folder)


def queue(spark: SparkSession, folder: str, files_at_once: int = 10) -> DataFrame:
    """The queue as a stream; ``files_at_once`` bounds what a micro-batch takes."""
    return spark.readStream.schema(ITEM).option("maxFilesPerTrigger", files_at_once).json(folder)


def to_queue(n_items: Column, threshold: int, alive: Column) -> Column:
    """Whether a request goes to the queue instead of being answered at once."""
    return F.lit(threshold > 0) & (n_items > threshold) & alive


def process(items: DataFrame) -> DataFrame:
    """A row for each item: ok with its masked text and regions, or an error with a detail. A bad item never fails its
    batch: what can't be masked is found by conditions, not by exceptions."""
    rows = items.withColumn("doc_id", F.struct("job_id", "item_id"))
    given = F.coalesce("mask_strings", F.array().cast("array<string>"))
    values = F.when(F.size(given) > 0, given).otherwise(F.when(F.col("text").isNotNull(), detect.detected(F.col("text"))))
    done = detect.mask(rows.withColumn("_values", values), "_values")
    error = F.when(F.col("masked").isNull(), "no text").when((F.col("regions") == 0) & (F.length("masked") == 0), "empty text")
    return done.select(
        "doc_id.job_id", "doc_id.item_id", F.when(error.isNull(), "ok").otherwise("error").alias("status"), F.when(error.isNull(), F.col("masked")).alias("masked"),
        F.when(error.isNull(), F.col("regions")).alias("regions"), F.substring(error, 1, 300).alias("detail"),
    )


def run(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Work the queue until it is empty: each micro-batch writes its results under its own number, so that a batch that is
    run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    rows = spark.read.parquet(out)
    return rows.groupBy("job_id", "item_id").agg(F.max(F.struct("batch", "status", "masked", "regions", "detail")).alias("r")).select("job_id", "item_id", "r.status", "r.masked", "r.regions", "r.detail")


def progress(results_: DataFrame, totals: DataFrame) -> DataFrame:
    """Counts and state of each submitted job (job_id, total)."""
    done = results_.groupBy("job_id").agg(F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") != "ok").alias("failed"))
    rows = totals.join(done, "job_id", "left").na.fill(0, ["succeeded", "failed"])
    over = F.col("succeeded") + F.col("failed")
    return rows.withColumn("pending", F.greatest(F.lit(0), F.col("total") - over)).withColumn("state", F.when(over >= F.col("total"), "done").when(over > 0, "running").otherwise("queued"))


def live_progress(stream: DataFrame) -> DataFrame:
    """Running counts by job over a stream of results (job_id, status), kept for seven days after a job's last row. Its
    time-outs need further batches, so a query over it runs until it is stopped (or once), never "available now"."""

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ok, bad = state.get if state.exists else (0, 0)
        for part in rows:
            good = int((part["status"] == "ok").sum())
            ok, bad = ok + good, bad + len(part) - good
        state.update((ok, bad))
        state.setTimeoutDuration(fixed.JOB_SECONDS * 1000)
        yield pd.DataFrame({"job_id": [key[0]], "succeeded": [ok], "failed": [bad]})

    return stream.groupBy("job_id").applyInPandasWithState(update, "job_id string, succeeded long, failed long", "ok long, bad long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def admitted(leases: DataFrame, waiting: DataFrame, now: Column, width: int = fixed.WIDTH, ttl: int = fixed.LEASE_SECONDS) -> DataFrame:
    """The waiting items (seq) that may start now: leases older than ``ttl`` seconds are gone, ``width`` run at a time."""
    running = leases.filter(F.unix_timestamp("started_at") > F.unix_timestamp(now) - ttl).count()
    return waiting.orderBy("seq").limit(max(0, width - running))


def retried(call, attempts: int = 3, wait: float = 1.5, sleep=None, transient=lambda e: False, expired=lambda e: False):
    """Run ``call(fresh)``: once more with a fresh session if the session had expired, and up to ``attempts`` times on
    transient failures, waiting longer each time."""
    import time

    sleep = sleep or time.sleep
    fresh, tried = False, 0
    while True:
        tried += 1
        try:
            return call(fresh)
        except Exception as e:
            if expired(e) and not fresh:
                fresh, tried = True, tried - 1
            elif transient(e) and tried < attempts:
                sleep(wait * tried)
            else:
                raise
