"""Streaming audit append with keyed state: each case keeps the last sequence number and hash of its chain.

The state of a case is one value in the state store of its partition, so a micro-batch touches the cases it has rows
of and no others, and a restart goes on from the checkpoint. Rows leave through the file sink, whose log makes a
repeated batch count once. Within a micro-batch the rows of a case are linked in the given order; across batches, in
order of arrival. They are sorted in memory, as many as one trigger brings for one case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from threadloom import schema
from threadloom.functions.chain import GENESIS, entry_payload

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Chain(StatefulProcessor):
    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tip = handle.getValueState("tip", "seq bigint, hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, previous = self.tip.get() if self.tip.exists() else (-1, GENESIS)
        batch = pd.concat(rows, ignore_index=True).sort_values(self.order, kind="stable")
        befores, hashes = [], []
        for payload in batch["payload"]:
            befores.append(previous)
            previous = hashlib.sha256((payload + previous).encode()).hexdigest()
            hashes.append(previous)
        self.tip.update((int(seq) + len(batch), previous))
        yield batch[["case_id", "ts", "action", "details"]].assign(
            seq=range(int(seq) + 1, int(seq) + 1 + len(batch)), prev_hash=befores, hash=hashes)[[f.name for f in schema.AUDIT.fields]]

    def close(self) -> None:
        pass


class ChainedStream:
    """Audit rows of a stream of events (case_id, ts, action, details, and the columns of ``order``)."""

    def __init__(self, spark: SparkSession, root: str, order: list[str]):
        self.spark, self.root, self.order = spark, root.rstrip("/"), order

    def linked(self, events: DataFrame) -> DataFrame:
        payload = entry_payload(F.col("action"), F.col("details"), F.col("ts"))
        return events.withColumn("payload", payload).groupBy("case_id").transformWithStateInPandas(
            _Chain(self.order), schema.AUDIT, outputMode="Append", timeMode="None")

    def start(self, events: DataFrame, **options) -> StreamingQuery:
        before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKS)  # a query keeps the settings it starts with
        try:
            writer = self.linked(events).writeStream.format("parquet").option("path", f"{self.root}/rows").option(
                "checkpointLocation", f"{self.root}/checkpoint")
            return writer.outputMode("append").trigger(**(options or {"availableNow": True})).start()
        finally:
            self.spark.conf.set(PROVIDER, before)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(schema.AUDIT).parquet(f"{self.root}/rows")
