"""Durable lineage cuts for iterative jobs.

Each cut is a Parquet table in the shared folder, so a lost executor never forces a loop
to start over, and the optimizer sees real file sizes when it picks join strategies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from threadloom.session import shared_root


class Workspace:
    """One folder per job; superseded rounds are dropped as the loop moves on."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.step = 0

    def path(self, tag: str) -> str:
        self.step += 1
        return f"{self.base}/{self.step:05d}-{tag}"

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._cut_path = path
        return table

    def drop(self, table: DataFrame | None) -> None:
        """Delete a cut nothing reads any more."""
        path = getattr(table, "_cut_path", None)
        if path is None:
            return
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
