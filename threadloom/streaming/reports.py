"""Incremental report ingest: each micro-batch resolves against what is stored for its cases and adds to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom import schema
from threadloom.operators.ingest import ingest_reports
from threadloom.operators.upsert import upsert_entities


class ReportStream:
    """Entities and partial edges per batch under one root."""

    def __init__(self, spark: SparkSession, root: str, names: DataFrame, gazetteer: DataFrame, fold_aliases: bool = True):
        self.spark, self.root = spark, root.rstrip("/")
        self.names, self.gazetteer, self.fold_aliases = names, gazetteer, fold_aliases

    def _before(self, number: int, docs: DataFrame) -> DataFrame:
        """Entities that earlier batches stored for the cases of this one; a repeated batch does not see its own rows."""
        stored = self.spark.read.parquet(f"{self.root}/entities").filter(F.col("batch") < number).drop("batch")
        return stored.join(docs.select("case_id").distinct(), "case_id", "left_semi")

    def _save(self, batch: DataFrame, number: int) -> None:
        # a batch of few large files would be read, and its texts cut, by as few tasks
        docs = batch.select("case_id", "doc_id", "text").repartition(self.spark.sparkContext.defaultParallelism)
        stored = self._before(number, docs) if number > 0 else None
        done = ingest_reports(docs, self.names, self.gazetteer, stored, self.fold_aliases)
        fresh = done.entities
        if stored is not None:
            fresh = fresh.join(stored.select(*schema.NODE_KEY), schema.NODE_KEY, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{self.root}/entities/batch={number}")
        done.edges().write.mode("overwrite").parquet(f"{self.root}/edges/batch={number}")

    def start(self, reports: DataFrame, checkpoint: str, **options) -> StreamingQuery:
        writer = reports.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self._save)
        return writer.trigger(**(options or {"availableNow": True})).start()

    def entities(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/entities").drop("batch")
        return upsert_entities(rows.limit(0), rows)

    def edges(self) -> DataFrame:
        """Confidences of all batches added; the sentence of the latest batch wins."""
        parts = self.spark.read.parquet(f"{self.root}/edges")
        sentence = F.max(F.when(F.col("source_sentence") != "", F.struct("batch", "source_sentence")))
        return parts.groupBy(*schema.EDGE_KEY).agg(
            F.sum("confidence").alias("confidence"), sentence["source_sentence"].alias("source_sentence")
        )
