"""Incremental call edges: each micro-batch adds a small table of partial edges.

Edge counts add and the last values win, so partial results of any batches can be merged on
read. A batch writes under its own number, which makes a repeated batch harmless, and no state
grows inside the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.upsert import latest
from threadloom.schema import EDGE_COLUMNS

PARTIAL = "case_id string, caller string, called string, n bigint, last_ts struct<o:bigint,v:string>, last_dur struct<o:bigint,v:string>"


def _last(value: str):
    return F.max(F.when(F.col(value) != "", F.struct(F.col("row_no").alias("o"), F.col(value).alias("v"))))


def partial_edges(calls: DataFrame) -> DataFrame:
    return calls.groupBy("case_id", "caller", "called").agg(
        F.count(F.lit(1)).alias("n"), _last("ts_raw").alias("last_ts"), _last("duration_raw").alias("last_dur")
    )


def write_partials(calls: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Stream of call rows to partial edges under ``path``."""
    def save(batch: DataFrame, number: int) -> None:
        partial_edges(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = calls.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return writer.trigger(**(options or {"availableNow": True})).start()


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges merged from all partial tables."""
    parts = spark.read.schema(PARTIAL).parquet(f"{path}/batch=*")
    merged = parts.groupBy("case_id", "caller", "called").agg(
        F.sum("n").cast("double").alias("confidence"), F.max("last_ts")["v"].alias("last_timestamp"),
        F.max("last_dur")["v"].alias("last_duration"),
    )
    return merged.select(
        F.col("case_id").alias("src_case"), F.lit("Phone").alias("src_label"), F.col("caller").alias("src_id"),
        F.lit("INTERCEPTED_CALL").alias("rel"), F.col("case_id").alias("dst_case"), F.lit("Phone").alias("dst_label"),
        F.col("called").alias("dst_id"), "confidence", F.lit(None).cast("string").alias("source_sentence"),
        "last_timestamp", "last_duration",
    ).select(*EDGE_COLUMNS)


def running_edges(calls: DataFrame, delay: str = "1 day") -> DataFrame:
    """Stateful form for update mode: rows repeated within ``delay`` of event time count once."""
    once = calls.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["case_id", "row_no"])
    return once.groupBy("case_id", "caller", "called").agg(
        F.count(F.lit(1)).alias("confidence"), latest("ts_raw", "row_no").alias("last_timestamp"),
        latest("duration_raw", "row_no").alias("last_duration"),
    )
