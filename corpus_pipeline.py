"""A training corpus from raw documents: language ID, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it kept with the columns it was given; the last
returns the packed pieces. A stage joins its operator's decisions back by doc_id, or by the text's digest where
rows without a doc_id count, with the smaller side broadcast only if its bytes, summed up, are few.

Defined cases, for every stage: an empty table gives no rows; null texts and ids, repeated rows and very long texts are what
the stage's docstring says; columns that aren't those of ``documents`` pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import decontam, langid, neardup, packing, secrets
from veilspan.llm.common import checked_small, hand_back, materialise, release_heaps, unused

#: No SQL form: tokenizer ids, k-means centroids and signatures are not SQL.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those without letters (null and empty texts too) or far from every
    centroid. Rows without a doc_id and repeated rows are judged like any other; without any labelled text all go."""
    out = unused("language", *docs.columns)
    return langid.identify(docs, out=out).filter(~F.col(out)["rejected"]).drop(out)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group stays; of rows that share a doc_id, one (the least by all columns).
    Rows without a doc_id, and documents without words, are in no group and stay."""
    release_heaps(spark)
    own, key = unused("id", *docs.columns), F.col("doc_id").cast("long")
    found = materialise(neardup.near_duplicates(docs), "dedup")
    drop = materialise(found.filter("not kept").select(F.col("doc_id").alias(own)).distinct(), "drop")
    kept = docs.join(checked_small(drop), key == F.col(own), "left_anti")
    twice = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    return kept if twice.isEmpty() else _one_each(kept)


def _one_each(docs: DataFrame) -> DataFrame:
    """One row for each doc_id: the least by all columns. Rows without a doc_id stay."""
    named = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("r")).select("r.*")
    return named.unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; null and empty texts hold none. A row's key is its text's digest, because
    many rows may have no doc_id."""
    release_heaps(spark)
    own = unused("of", *docs.columns)
    keyed = docs.select(secrets.blob_of(F.col("text")).alias("doc_id"), "text")
    found = decontam.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    drop = materialise(found.select(F.col("doc_id").alias(own)).distinct(), "leaks")
    return docs.join(checked_small(drop), secrets.blob_of(F.col("text")) == F.col(own), "left_anti")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret found in its text is replaced by a mark, and n_chars follows. A null text
    stays null; rows with one text are changed alike."""
    release_heaps(spark)
    of, blob, held = (unused(n, *docs.columns) for n in ("of", "blob", "spans"))
    found = secrets.find(docs).filter(F.size("spans") > 0)
    spans = materialise(found.select(F.col("blob").alias(blob), F.col("spans").alias(held)).dropDuplicates([blob]), "secrets")
    marked = docs.withColumn(of, secrets.blob_of(F.col("text"))).join(checked_small(spans), F.col(of) == F.col(blob), "left")
    text = F.when(F.col(held).isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col(held)))
    columns = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(held).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return marked.select(*[columns.get(c, F.col(f"`{c}`")) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 4096 tokens, in sequences of as many: a null or empty text is its end id alone, a
    repeated row is packed as often as it occurs, only longer documents are cut."""
    hand_back()
    release_heaps(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
