"""Binary token files: ids of all documents in ascending doc_id order, as range-coded blocks.

A file set is a Parquet folder of self-contained blocks (``rans``), so that any store Spark reads can hold it and a
lost task's half-written files are never seen, plus a one-row folder with the shared frequency table and a folder
that says where each range of documents begins in the whole stream. A block holds whole documents of one range; its
index names them with their lengths, and ``start`` is its first id's place in the range. Blocks decode independently,
and within a block any checkpoint is a place to begin.

Defined results: a null or empty text is the end id alone; rows without a doc_id come first; repeated ids stay next
to each other in order of their text's ids; a document longer than a block is a block of its own; an empty table is
an empty file set; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import common, rans, tokens
from threadloom.operators.cutting import Workspace

#: Ids in a block, from which on it ends with the document at hand.
BLOCK_IDS = 1 << 18
#: Ids of a range of documents, which one task codes.
RANGE_IDS = 1 << 23

COUNTS = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("n", T.LongType())])
BLOCKS = T.StructType([
    T.StructField("range", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("docs", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("payload", T.BinaryType()),
])
BLOCKS_ARROW = pa.schema([("range", pa.int64()), ("block", pa.int32()), ("start", pa.int64()), ("docs", pa.list_(pa.int64())),
                          ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
ROWS = T.StructType([T.StructField(n, T.LongType()) for n in ("range", "doc_id", "start", "n_tokens", "ids_crc32")] + [T.StructField("ids", T.BinaryType())])
ROWS_ARROW = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in ROWS])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        ids = batch.column("ids")
        ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, offset=4 * ids.offset)
        if len(ids) and ends[-1] > ends[0]:  # all ids of the batch lie behind each other
            total += np.bincount(np.frombuffer(ids.buffers()[2], "<u2", (ends[-1] - ends[0]) // 2, ends[0]), minlength=1 << 16)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["id", "n"])


def frequencies(table: DataFrame) -> rans.Frequencies:
    """The shared table from the counts of every id in all documents (as many rows as the vocabulary has ids)."""
    rows = table.select("ids").mapInArrow(_count, COUNTS).groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16, np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return rans.Frequencies.of_counts(counts)


def _encode(table) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = table.value
        at, now, number = 0, None, 0
        docs: list = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            nonlocal docs, held, at, number
            ids = np.concatenate(held)
            lengths = [len(x) for x in held]
            row = [now, number, at, docs, lengths, rans.encode(ids, shares)]
            docs, held, at, number = [], [], at + len(ids), number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, BLOCKS_ARROW)], schema=BLOCKS_ARROW)

        size = 0
        for batch in batches:
            for doc, key, binary in zip(*(batch.column(c) for c in ("doc_id", "range", "ids"))):
                if key.as_py() != now or size >= BLOCK_IDS:
                    if docs:
                        yield block()
                    size = 0
                    if key.as_py() != now:
                        now, at, number = key.as_py(), 0, 0
                docs.append(doc.as_py())
                held.append(tokens.unpack(binary.as_buffer()).copy())
                size += len(held[-1])
        if docs:
            yield block()

    return run


def write(docs: DataFrame, folder: str, vocabulary: str | None = None) -> None:
    """Encode all texts and store their ids in ascending doc_id order under ``folder``."""
    spark = docs.sparkSession
    work = Workspace(spark, "tokenfile")
    table = tokens.token_table(docs, work, vocabulary)
    shares = frequencies(table)
    spark.createDataFrame([(bytearray(shares.tobytes()),)], "shares binary").write.parquet(f"{folder}/frequencies")
    ranged = table.withColumn("range", common.doc_ranges(table, RANGE_IDS, "n_tokens"))
    totals = ranged.groupBy("range").agg(F.sum("n_tokens").alias("total"))
    tokens.starts(totals, "range").write.parquet(f"{folder}/ranges")
    ordered = ranged.select("range", "doc_id", "ids").repartition("range").sortWithinPartitions("range", "doc_id", "ids")
    coded = ordered.mapInArrow(_encode(spark.sparkContext.broadcast(shares)), BLOCKS)
    coded.write.option("compression", "none").parquet(f"{folder}/blocks")


def _decode(table, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, start, docs, lengths, payload in zip(*(batch.column(c) for c in ("range", "start", "docs", "lengths", "payload"))):
                ids = rans.decode(payload.as_buffer().to_pybytes(), table.value)
                size = np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(size)
                begins = ends - size
                parts = [ids[a:b] for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(size), key.as_py(), np.int64)), pa.array(docs.as_py(), pa.int64()), pa.array(start.as_py() + begins), pa.array(size),
                    pa.array([common.id_crc(p) for p in parts], pa.int64()),
                    pa.array([p.astype("<u4").tobytes() if with_ids else None for p in parts], pa.binary()),
                ], schema=ROWS_ARROW)

    return run


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Rows of a file set: doc_id, start, n_tokens, ids_crc32 (and ids, unsigned 32-bit little-endian)."""
    shares = rans.Frequencies.frombytes(bytes(spark.read.parquet(f"{folder}/frequencies").first()[0]))
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select(
        "range", "start", "docs", "lengths", "payload")
    rows = blocks.mapInArrow(_decode(spark.sparkContext.broadcast(shares), with_ids), ROWS)
    bases = spark.read.parquet(f"{folder}/ranges")
    placed = tokens.with_starts(rows if with_ids else rows.drop("ids"), bases, "range", Workspace(spark, "tokenfile"))
    return placed.withColumn("start", F.col("base") + F.col("start")).drop("range", "base")
