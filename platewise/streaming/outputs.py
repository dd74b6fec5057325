"""Outputs of a stream whose tables become visible together.

A micro-batch writes several tables.  Each attempt to write them has folders of its own,
``<table>/batch_id=<n>/attempt=<id>``, and counts only once its commit file exists:
``commits/batch-<n>.json`` names the attempt and is put in place by one rename.  A reader joins
the tables with the commits, so a batch that failed half-way leaves nothing visible, a
repeated batch counts once, and a batch that was committed is not written again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from platewise.session import path_exists

COMMIT = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("attempt", T.StringType())])


class BatchOutputs:
    """Tables under ``root``, one commit per micro-batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _commit_path(self, batch_id: int) -> str:
        return f"{self.root}/commits/batch-{batch_id:012d}.json"

    def committed(self, batch_id: int) -> bool:
        return path_exists(self.spark, self._commit_path(batch_id))

    def write(self, batch_id: int, tables: dict[str, DataFrame]) -> None:
        """Write the tables of a micro-batch and commit them; nothing if it is committed."""
        if self.committed(batch_id):
            return
        attempt = f"a{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.mode("error").parquet(f"{self.root}/{name}/batch_id={batch_id}/attempt={attempt}")
        self._commit(batch_id, attempt)

    def _commit(self, batch_id: int, attempt: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        done = jvm.org.apache.hadoop.fs.Path(self._commit_path(batch_id))
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits/_{attempt}")
        fs = done.getFileSystem(conf)
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"batch_id": batch_id, "attempt": attempt}).encode()))
        out.close()
        if not fs.rename(draft, done) and not fs.exists(done):
            raise OSError(f"can't commit batch {batch_id} in {self.root}")

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMIT).json(f"{self.root}/commits")

    def read(self, name: str, schema: T.StructType | str) -> DataFrame:
        """Rows of the committed attempts of a table; none before the first commit of the table."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not (path_exists(self.spark, f"{self.root}/commits") and path_exists(self.spark, f"{self.root}/{name}")):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema, *COMMIT])).parquet(f"{self.root}/{name}")
        return rows.join(self.commits(), ["batch_id", "attempt"], "left_semi").select(*schema.names)
