"""Packing by concatenation and cutting.

Pass one encodes every document and keeps, per task, the running token position; pass two turns the totals of the
tasks into global offsets by a prefix sum and cuts the one long token stream into windows of ``size`` ids. Every
window but the last is full; a document that crosses window borders has one boundary record per piece.

Defined results: a null or empty text is the end id alone; repeated rows are packed as often as they occur; rows
without an id keep a null id; an empty table has no pieces; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import common, tokens
from threadloom.operators.cutting import Workspace

SIZE = 4096

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in (
    "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("ids", T.BinaryType())])
ARROW = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in PIECES])


def _cut(size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: [] for name in ARROW.names}
            for doc, at, binary in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "ids"))):
                ids = tokens.unpack(binary)
                first = size - at % size
                edges = [0, *range(first, len(ids), size), len(ids)]
                for a, b in zip(edges, edges[1:]):
                    row = (doc, a, b - a, common.id_crc(ids[a:b]), len(ids), (at + a) // size, (at + a) % size,
                           ids[a:b].tobytes() if with_ids else None)
                    for name, value in zip(ARROW.names, row):
                        cols[name].append(value)
            yield pa.RecordBatch.from_pydict(cols, schema=ARROW)

    return run


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a window: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    work = Workspace(docs.sparkSession, "packing")
    table = tokens.token_table(docs, work, vocabulary)
    bases = tokens.starts(table.groupBy("part").agg(F.sum("n_tokens").alias("total")), "part")
    placed = tokens.with_starts(table, bases, "part", work).select("doc_id", (F.col("base") + F.col("local")).alias("at"), "ids")
    pieces = placed.mapInArrow(_cut(size, with_ids), PIECES)
    return pieces if with_ids else pieces.drop("ids")


def padding(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Per window its ids, and the padding that brings it to ``size`` (none where the length is a power of two)."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"))
    power = F.pow(F.lit(2.0), F.ceil(F.log2("n_ids"))) == F.col("n_ids")
    return filled.withColumn("padding", F.when(power, 0).otherwise(size - F.col("n_ids")).cast("long"))
