"""Resolving records: prioritised look-ups, registry merges, upserts, and the files to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scalars


def with_contact(applicants: DataFrame, contacts: DataFrame) -> DataFrame:
    """Applicants beside their contact; a contact that isn't there leaves nulls."""
    return applicants.join(contacts.withColumnRenamed("name", "contact_name"), "contact_id", "left")


def contact_values(contacts: DataFrame, fields: list[str]) -> DataFrame:
    """The filled fields of a contact, in the fields' order, each value once: contact_id, ord, value."""
    kept = F.array_distinct(F.filter(F.array(*fields), lambda v: v.isNotNull() & (F.trim(v) != "")))
    return contacts.select("contact_id", F.posexplode(kept).alias("ord", "value"))


def newest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in the given order. Spark prunes each partition to its own first rows before
    the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def file_rank(name: Column) -> Column:
    ext = scalars.extension(name)
    out = F.lit(None).cast("int")
    for i, e in enumerate(fixed.FILE_RANK):
        out = F.when(ext == e, F.lit(i)).otherwise(out)
    return out


#: Where a file may be, in the order in which places are asked.
PLACES = (("file", "applicant"), ("file", "contact"), ("attachment", "applicant"), ("attachment", "contact"))


def place_rank(storage: Column, parent: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, (s, p) in enumerate(PLACES):
        out = F.when((storage == s) & (parent == p), F.lit(i)).otherwise(out)
    return out


def best_file(files: DataFrame) -> DataFrame:
    """The file to use for each applicant: the first place with a usable file, there by kind, then the newest; of equal
    ones the smaller number, then the first name, so that the choice never depends on the order of rows. Own outputs are never a source."""
    rows = files.filter(~scalars.is_masked_output(F.col("name"))).withColumn("rank", file_rank(F.col("name"))).filter("rank is not null")
    rows = rows.withColumn("place", place_rank(F.col("storage"), F.col("parent")))
    return newest(rows, ["applicant_id"], [F.col("place"), F.col("rank"), F.desc("created_at"), F.col("file_no"), F.col("name")])


def file_outcome(applicants: DataFrame, files: DataFrame) -> DataFrame:
    """found, unusable (there are files, none that can be used) or missing, for each applicant."""
    own = ~scalars.is_masked_output(F.col("name"))
    seen = files.groupBy("applicant_id").agg(F.count_if(own).alias("others"), F.count_if(own & file_rank(F.col("name")).isNotNull()).alias("usable"))
    rows = applicants.select("applicant_id").join(seen, "applicant_id", "left")
    return rows.select("applicant_id", F.when(F.col("usable") > 0, "found").when(F.col("others") > 0, "unusable").otherwise("missing").alias("outcome"))


def merged_registry(env: DataFrame, db: DataFrame) -> DataFrame:
    """Both registries; where both know a key, the table wins over the environment."""
    e, d = env.withColumnRenamed("client_id", "env_id"), db.withColumnRenamed("client_id", "db_id")
    rows = e.join(d, "client_key", "full")
    return rows.select("client_key", F.coalesce("db_id", "env_id").alias("client_id"), F.when(F.col("db_id").isNotNull(), "db").otherwise("env").alias("source"))


def upsert(current: DataFrame, changes: DataFrame, key: str, at: Column) -> DataFrame:
    """Rows of (key, values, created_at, updated_at) with the changes over them: created_at stays, updated_at is ``at``. Of
    several changes for one key the greatest by its values counts, so that the result never depends on the order of rows."""
    fresh = changes.withColumn("created_at", at).withColumn("updated_at", at).withColumn("_new", F.lit(1))
    both = current.withColumn("_new", F.lit(0)).unionByName(fresh)
    w = Window.partitionBy(key)
    kept = both.withColumn("_first", F.min("created_at").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("_new"), *[F.desc(c) for c in changes.columns if c != key])))
    return kept.filter("_r = 1").withColumn("created_at", F.col("_first")).drop("_new", "_first", "_r")


def delete(current: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What is left, and for each key asked for whether it was there."""
    had = keys.join(current.select(key).withColumn("existed", F.lit(True)), key, "left").select(key, F.coalesce("existed", F.lit(False)).alias("existed"))
    return current.join(keys, key, "left_anti"), had


def parse_registry(raw: DataFrame) -> DataFrame:
    """Rows of a registry given as one json object by client key; error says which entry lacks a field."""
    fields = ["client_id", "client_secret", "token_url", "instance_url"]
    kind = "map<string,struct<" + ",".join(f"{f}:string" for f in fields) + ">>"
    parsed = raw.select(F.from_json("json", kind).alias("m"))
    rows = parsed.select(F.explode_outer("m").alias("client_key", "e")).select("client_key", "e.*")
    lacking = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.trim(f), F.lit("")) == "", F.lit(f)) for f in fields])), ",")
    return rows.withColumn("error", F.when(F.col("client_key").isNull(), "not an object").when(lacking != "", F.concat(F.lit("missing "), lacking)))


def watermark_choice(inline: Column, account: Column, everyone: Column, text: Column) -> Column:
    """struct(source, value) of the first watermark that is there."""
    def choice(source: str, value: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), value.cast("string").alias("value"))

    return (
        F.when(inline.isNotNull(), choice("request", inline))
        .when(account.isNotNull(), choice("account", account))
        .when(everyone.isNotNull(), choice("global", everyone))
        .when(F.coalesce(text, F.lit("")) != "", choice("text", text))
        .otherwise(choice("none", F.lit(None)))
    )


def fields_of(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted fields that a table has, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def fan_out(requested: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """One row for each requested id: its answer, or an error where none came."""
    rows = requested.join(answers, key, "left")
    return rows.select(key, F.coalesce("status", F.lit("error")).alias("status"), F.coalesce("detail", F.lit("no answer")).alias("detail"))
