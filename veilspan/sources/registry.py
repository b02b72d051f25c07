"""The client registry as a table: read, upsert, delete, create; written whole beside the old one and then switched."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import resolve

SCHEMA = "client_key string, client_id string, encrypted_client_secret string, token_url string, instance_url string, created_at timestamp, updated_at timestamp"


class Registry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _version(self) -> str | None:
        p, fs = self._fs("current")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        return names[-1] if names else None

    def create(self) -> None:
        """Make the table if it isn't there."""
        if self._version() is None:
            self._write(self.spark.createDataFrame([], SCHEMA))

    def read(self) -> DataFrame:
        version = self._version()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{version}") if version else self.spark.createDataFrame([], SCHEMA)

    def _write(self, rows: DataFrame) -> None:
        last = self._version()
        version = f"v{int(last[1:9]) + 1 if last else 0:08d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{version}")
        p, fs = self._fs(f"current/{version}")
        fs.create(p, True).close()

    def upsert(self, changes: DataFrame, at=None) -> None:
        self._write(resolve.upsert(self.read(), changes, "client_key", at if at is not None else F.current_timestamp()).select(*[c.split()[0] for c in SCHEMA.split(", ")]))

    def delete(self, keys: DataFrame) -> DataFrame:
        """Delete, and say of each key whether it was there."""
        left, had = resolve.delete(self.read(), keys, "client_key")
        answer = f"{self.path}/answers/{uuid.uuid4().hex}"
        had.write.parquet(answer)  # before the switch, after which every key would be gone
        self._write(left)
        return self.spark.read.schema(had.schema).parquet(answer)
