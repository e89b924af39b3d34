"""Streaming audit append: chain tips are kept as a small table per batch.

The tip (last sequence number and hash) of each case is the only state. Rows of a batch are
linked by the same sorted pass as the batch append, so a busy case never has to fit in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom import schema
from threadloom.operators import audit as au


class AuditStream:
    def __init__(self, spark: SparkSession, root: str, order: list[str]):
        self.spark, self.root, self.order = spark, root.rstrip("/"), order

    def _tips(self, number: int) -> DataFrame:
        """Last row per case before this batch, in the shape of audit rows."""
        if number == 0:
            return self.spark.createDataFrame([], schema.AUDIT)
        return self.spark.read.schema(schema.AUDIT).parquet(f"{self.root}/tips/batch={number - 1}")

    def _save(self, batch: DataFrame, number: int) -> None:
        before = self._tips(number)
        path = f"{self.root}/rows/batch={number}"
        au.append(before, batch, self.order).write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(schema.AUDIT).parquet(path)
        columns = [f.name for f in schema.AUDIT.fields]
        last = before.unionByName(rows).groupBy("case_id").agg(F.max_by(F.struct(*columns), "seq").alias("r"))
        last.select("r.*").write.mode("overwrite").parquet(f"{self.root}/tips/batch={number}")
        # the tips before this batch stay for a repeat of it; older ones are never read again
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/tips/batch={number - 2}")
        old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def start(self, events: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self._save)
        return writer.trigger(**(options or {"availableNow": True})).start()

    def rows(self) -> DataFrame:
        return self.spark.read.schema(schema.AUDIT).parquet(f"{self.root}/rows/batch=*")
