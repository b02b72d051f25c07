"""Delta-maintained token counts.

Totals by source, language and tokenizer version are a maintained table. A batch is a table of signed changes: an insert
adds a document's counts, a delete takes them away, a revision takes the old ones away and adds the new ones (under another
source, language or tokenizer version if those changed). A commit sums the batch by group, adds it to the totals of
the commit before, and writes the sum as the next numbered state; the marker that names the batch comes last and makes that
state the current one. So reading totals reads one small state, whatever the number of batches, and a commit
that is repeated after a crash, or sent twice, changes nothing. One writer commits at a time.

Defined cases: null sources and languages are groups of their own; a null text has no tokens; repeated rows count as
often as they stand there; an empty batch is a batch; groups whose documents are all gone leave the totals; other
columns are ignored.
"""

from __future__ import annotations

from urllib.parse import quote_plus, unquote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import fresh_path, text_batches

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = ["n_docs", "n_tokens", "n_bytes"]
TOKENIZER_VERSION = "word_bpe_49k-1"


def counter(path: str | None = None):
    """A column function: text to its number of token ids."""
    path = path or tokens.default_path()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = tokens.encoder(path)
        return pd.Series([len(enc.ids(t)) // 4 if isinstance(t, str) else 0 for t in texts], dtype="int64")

    return count


def counted(docs: DataFrame, version: str = TOKENIZER_VERSION, path: str | None = None, keep: list[Column] | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer_version, n_tokens and n_bytes of each document, and the columns to ``keep``."""
    text_batches(docs.sparkSession)
    text = F.col("text")
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer_version"),
        counter(path)(text).alias("n_tokens"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), *(keep or []),
    )


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.lit(sign) * F.col("n_tokens")).alias("n_tokens"), (F.lit(sign) * F.col("n_bytes")).alias("n_bytes"))


def inserts(rows: DataFrame) -> DataFrame:
    return _signed(rows, 1)


def deletes(rows: DataFrame) -> DataFrame:
    return _signed(rows, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts out, new counts in."""
    return deletes(old).unionByName(inserts(new))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed changes from one snapshot of ``counted`` to the next: what differs in any way leaves and enters."""
    return deletes(before.exceptAll(after)).unionByName(inserts(after.exceptAll(before)))


class Rollup:
    """Totals in a folder: ``delta`` has each batch's sums, ``state`` the totals after it, ``done`` the markers."""

    SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_bytes long"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "rollup")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _state(self, number: int) -> str:
        return f"{self.path}/state/{number:09d}"

    def _done(self) -> list[tuple[int, str]]:
        p, fs = self._fs("done")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        return [(int(n[:9]), unquote_plus(n[10:])) for n in names]

    def batches(self) -> list[str]:
        return [name for _, name in self._done()]

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Add a batch; False, without reading the delta, if a batch of that name is committed already."""
        done = self._done()
        if any(name == batch for _, name in done):
            return False
        number = done[-1][0] + 1 if done else 1
        name = f"{number:09d}-{quote_plus(batch)}"
        _summed(delta).write.mode("overwrite").parquet(f"{self.path}/delta/{name}")
        change = self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/delta/{name}")
        _alive(_summed(self.totals().unionByName(change))).write.mode("overwrite").parquet(self._state(number))
        marker, fs = self._fs(f"done/{name}")
        fs.create(marker, False).close()
        old, fs = self._fs(f"state/{number - 2:09d}")
        fs.delete(old, True)  # the state before the last stays, for who is reading it
        return True

    def totals(self) -> DataFrame:
        done = self._done()
        if not done:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self._state(done[-1][0]))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])


def _alive(totals: DataFrame) -> DataFrame:
    return totals.filter("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0")
