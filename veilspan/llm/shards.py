"""Contiguous byte-balanced shards by global prefix sums.

Rows are dealt into ranges of doc_id; each range's total is known after one slim pass, the totals' prefix sums
(one row for each range, not for each document) place every range, and a running sum inside a range places its
rows. A row belongs to the shard in which the middle of its bytes lies. No text is moved.

Defined cases: a null text has size 1 and the checksum of no bytes; null doc_ids come first; repeated rows and
ties are ordered by checksum and size and each keeps a slot of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARDS = 16


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``) and start_byte."""
    text = F.col(text_col)
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    keys = ["doc_id", "text_crc32", "size"]
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, so that the range a row fell in stays fixed whatever is recomputed later.
    # The last key deals equal rows, of which one table may hold very many, to several ranges.
    dealt = slim.withColumn("turn", F.monotonically_increasing_id())
    ranged = materialise(dealt.repartitionByRange(parts, *keys, "turn").drop("turn").withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before, at, row = [], 0, 0
    for t in totals:  # one row for each range
        before.append((t["part"], at, row))
        at, row = at + t["bytes"], row + t["n"]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(before or [(0, 0, 0)], "o_part int, o_bytes long, o_row long")
    running = Window.partitionBy("part").orderBy(*keys)
    ahead = F.coalesce(F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranged.withColumn("p_byte", ahead).withColumn("p_row", F.row_number().over(running) - 1)
    rows = rows.join(F.broadcast(offsets), F.col("part") == F.col("o_part"))
    start, whole = F.col("p_byte") + F.col("o_bytes"), max(at, 1)
    # twice the middle of the row times the shards, over twice the whole: exact in decimals at any size
    middle = (2 * start + F.col("size")).cast("decimal(30,0)") * F.lit(shards)
    shard = F.least(F.lit(shards - 1), F.floor(middle / F.lit(2 * whole).cast("decimal(20,0)")).cast("int"))
    rows = rows.select(*keys, (F.col("p_row") + F.col("o_row")).alias("row"), start.alias("start_byte"), shard.alias("shard"))
    firsts = rows.groupBy("shard").agg(F.min("row").alias("first_row"))  # one row for each shard
    return rows.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "start_byte",
    )
