"""What the operators of this subpackage share: the shared scratch folder and size-checked joins."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rows (as counted by ``row_bytes``) that may be broadcast. Beyond it the same join shuffles.
BROADCAST_BYTES = 32 << 20
#: Rows in one Arrow batch of texts; keeps a batch of long documents within a Python worker's memory.
ARROW_ROWS = 250

_scratch: dict[str, str] = {}
_caches: dict[str, dict] = {}


def worker_cache(owner: str, make=dict) -> dict:
    """A Python worker's look-up table for one operator. Workers live on from operator to operator, so the tables of
    all others are emptied: a worker never holds more than one."""
    others = [t for name, t in _caches.items() if name != owner and t]
    for table in others:
        table.clear()
    if others:
        hand_back()
    return _caches.setdefault(owner, make())


def hand_back() -> None:
    """Give freed memory back to the system: allocators keep it otherwise, in every idle worker."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def release_heaps(spark: SparkSession) -> None:
    """``hand_back`` for the executors' JVMs: a heap keeps what an earlier step has touched until a full collection. One
    short task for each executor runs it, tenths of a second; no result depends on it."""
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is listed too
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS gc").write.format("noop").mode("overwrite").save()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at exit
        return


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``. Where that is unset, a local one serves a local
    session, as in tests; on a cluster the executors could not see it, so there it is an error."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = f"{tempfile.gettempdir()}/veilspan-{uuid.uuid4().hex}"
            spark.sparkContext.setCheckpointDir(base)
        _scratch[app] = f"{base.rstrip('/')}/veilspan-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from files every executor can
    see, so losing an executor costs a reread and not the whole lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch (session-wide; only the batch size changes, never a result)."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def solid(doc_id: Column) -> tuple[Column, Column]:
    """A doc_id that pandas can carry: doc_id (0 if null) and no_id. A column of longs with a null among them would
    become one of doubles there, which alters ids over 2^53."""
    own = doc_id.cast("long")
    return F.coalesce(own, F.lit(0)).alias("doc_id"), own.isNull().alias("no_id")


def nullable(df: DataFrame) -> DataFrame:
    """What ``solid`` did, undone."""
    return df.select(*[F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id") if c == "doc_id" else F.col(f"`{c}`") for c in df.columns if c != "no_id"])


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    """What a value takes in a hashed relation, or a little more."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((_value_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        simple = not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType))
        each = F.size(value).cast("long") * 8 if simple else F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _value_bytes(x, kind.elementType))
        return F.coalesce(each, F.lit(0)) + 24
    if isinstance(kind, T.MapType):
        return _value_bytes(F.map_entries(value), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    return F.lit(8).cast("long")


def row_bytes(df: DataFrame) -> Column:
    """The bytes of a row in a hashed relation: its values and 48 for itself."""
    return sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(48).cast("long"))


def checked_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """The table with a broadcast hint if its rows' bytes, summed up, are at most ``most`` (``BROADCAST_BYTES``), else as it
    is, so that the join shuffles. The table should be materialised: it is read here."""
    most = BROADCAST_BYTES if most is None else most
    total = df.select(row_bytes(df).alias("b")).agg(F.sum("b")).first()[0] or 0
    return F.broadcast(df) if total <= most else df


def unused(name: str, *taken: str) -> str:
    """The name with underscores before it until none of the names taken is equal to it, whatever their case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def words_of(text):
    """Lower-cased (A-Z) words, split at ASCII white space, as bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
