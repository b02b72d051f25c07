"""Sinks: masked copies, watermark files and queue items. Sources are never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scalars


def masked_copies(masked: DataFrame, path: str) -> None:
    """New versions titled after their source; the source stays as it is."""
    rows = masked.withColumn("title", F.concat(F.lit(fixed.MASKED_PREFIX), F.col("doc_id").cast("string")))
    rows.write.mode("append").parquet(path)


def accepted_watermarks(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads (name, body) that are images, with their kind, and the rest with the reason."""
    kind = scalars.image_kind(F.col("body"))
    rows = uploads.withColumn("kind", kind).withColumn("error", F.when(F.coalesce(F.octet_length("body"), F.lit(0)) == 0, "empty").when(kind.isNull(), "not a PNG or JPEG"))
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("name", "error")


def documents_of(files: DataFrame, convert=None) -> DataFrame:
    """Text documents from binary files (path, content): UTF-8 as it is; other formats by ``convert``, an iterator function for
    ``mapInPandas`` with the schema path, text, error (a converter is no part of this engine)."""
    if convert is not None:
        return files.mapInPandas(convert, "path string, text string, error string")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", text.alias("text"), F.when(text.isNull(), "not UTF-8 text").alias("error"))
