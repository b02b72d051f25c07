"""Batch requests and answers as json: parsing with typed errors, overrides, and the roll-up in request order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

ITEM = "struct<job_applicant_id:string,account_id:string,mask_strings:array<string>,watermark_base64:string>"
BATCH = f"items array<{ITEM}>, client_key string, watermark_text string, watermark_base64 string"
#: Items of one request.
MOST_ITEMS = 500


def parse(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (job_id, json): the items (job_id, idx, id, mask_strings, client_key, watermark and its text), and the requests that
    can't be used with an error. An item's own watermark goes before its batch's; text and key are the batch's."""
    rows = requests.select("job_id", F.from_json("json", BATCH).alias("r"), F.col("json"))
    n = F.coalesce(F.size("r.items"), F.lit(0))
    error = F.when(F.col("r.items").isNull(), "not a batch request").when(n < 1, "no items").when(n > MOST_ITEMS, f"more than {MOST_ITEMS} items")
    rows = rows.withColumn("error", error)
    items = rows.filter("error is null").select("job_id", "r", F.posexplode("r.items").alias("idx", "i"))
    items = items.select(
        "job_id", "idx", F.col("i.job_applicant_id").alias("id"), F.coalesce("i.mask_strings", F.array().cast("array<string>")).alias("mask_strings"),
        F.col("r.client_key").alias("client_key"), scalars.item_override(F.col("i.watermark_base64"), F.col("r.watermark_base64")).alias("watermark"),
        F.col("r.watermark_text").alias("watermark_text"), F.try_to_binary(scalars.item_override(F.col("i.watermark_base64"), F.col("r.watermark_base64")), F.lit("base64")).alias("image"),
    )
    return items, rows.filter("error is not null").select("job_id", "error")


def answer(results: DataFrame) -> DataFrame:
    """(job_id, succeeded, failed, json) from (job_id, idx, id, status, regions, detail): results stand in the order of the request."""
    one = F.struct("idx", "id", "status", "regions", F.substring("detail", 1, 300).alias("detail"))
    rows = results.groupBy("job_id").agg(F.count_if(F.col("status") == "ok").alias("succeeded"), F.count_if(F.col("status") != "ok").alias("failed"), F.array_sort(F.collect_list(one)).alias("results"))
    return rows.select("job_id", "succeeded", "failed", F.to_json(F.struct("succeeded", "failed", "results")).alias("json"))
