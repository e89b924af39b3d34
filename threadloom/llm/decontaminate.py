"""Benchmark decontamination.

The normalised word windows of the benchmark form a hash set that goes to every task; a scan over whole
documents looks each of its own windows up there, verifies every hit word by word, and marks the words that lie
inside an occurrence. The set is broadcast in blocks of benchmark items whose size is bounded by
``block_words``; a larger benchmark takes more blocks, each scanned in turn, so nothing broadcast grows without
limit and no item is left out.

Defined results: null and empty texts have no words; an item without words or without an id is never found; items
that repeat count once by id; documents that repeat are judged one by one; extra columns are ignored by
``scan`` and kept by ``remove_documents`` and ``remove_spans``; empty tables give no rows (documents) or no hits
(benchmark).
"""

from __future__ import annotations

import hashlib
import math
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import common

WINDOW = 10
#: Most benchmark words in one broadcast block, about 100 bytes each in a task.
BLOCK_WORDS = 1_000_000

CLASSES = common.byte_classes(word=string.digits + string.ascii_letters)
HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                  ("items", pa.list_(pa.string()))])
HITS_SPARK = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


class WindowSet:
    """The windows of a block of items: a bitmap and sorted hashes to look up, words to verify against."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.exact: dict[bytes, list[str]] = {}
        hashes: dict[int, set[int]] = {}
        for item, text in items:
            words = common.Words(pa.array([text], pa.large_string()), CLASSES)
            k = min(size, len(words.hash))
            if not k:
                continue
            for at, value in zip(*words.windows(k)):
                owners = self.exact.setdefault(words.text(int(at), k), [])
                if item not in owners:
                    owners.append(item)
                hashes.setdefault(k, set()).add(int(value))
        self.hashes = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in hashes.items()}
        self.maps = {}
        for k, v in self.hashes.items():
            self.maps[k] = np.zeros(1 << 20, bool)
            self.maps[k][v >> np.uint64(44)] = True

    def find(self, words: common.Words) -> list[tuple[int, int, list[str]]]:
        """(first word, words, items) of every verified occurrence."""
        found = []
        for k, known in self.hashes.items():
            at, value = words.windows(k)
            may = self.maps[k][value >> np.uint64(44)]
            at, value = at[may], value[may]
            for i in at[np.isin(value, known)].tolist():
                if owners := self.exact.get(words.text(i, k)):
                    found.append((i, k, owners))
        return found


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _scan_block(windows) -> Column:
    """Column function from text to its words and verified hits of one block."""

    @F.arrow_udf(HITS_SPARK)
    def hits(texts: pa.Array) -> pa.Array:
        texts, rows = common.whole(texts), []
        for a, b in common.slices(texts):
            words = common.Words(texts.slice(a, b - a), CLASSES)
            part = [{"n_words": int(n), "spans": [], "items": []} for n in np.diff(words.first)]
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            for i, k, owners in windows.value.find(words):
                row = int(words.row[i])
                local = i - int(words.first[row])
                spans.setdefault(row, []).append((local, local + k))
                items.setdefault(row, set()).update(owners)
            for row, own in spans.items():
                part[row]["spans"] = [{"start": x, "stop": y} for x, y in _merge(own)]
                part[row]["items"] = sorted(items[row])
            rows += part
        return pa.array(rows, HITS)

    return hits


def window_blocks(items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """Broadcast window sets of all items, each over at most about ``block_words`` words."""
    spark = items.sparkSession
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body")).filter(
        "item is not null and body is not null")
    length = F.length("body") / 2 + 1  # at least the number of words
    total = rows.agg(F.sum(length)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    out = []
    for b in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        out.append(spark.sparkContext.broadcast(WindowSet([(r.item, r.body) for r in own], size)))
    return out


def occurrences(items: DataFrame, text: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS) -> Column:
    """struct(n_words, spans of hit words, sorted items) of a text column against a benchmark table."""
    blocks = [_scan_block(b)(F.col(text)) for b in window_blocks(items, size, block_words)]
    if len(blocks) == 1:
        return blocks[0]
    return F.struct(
        blocks[0]["n_words"].alias("n_words"),
        F.concat(*[b["spans"] for b in blocks]).alias("spans"),
        F.array_sort(F.array_distinct(F.concat(*[b["items"] for b in blocks]))).alias("items"),
    )


@F.arrow_udf(T.LongType())
def _covered(spans: pa.Array) -> pa.Array:
    """Words in the union of spans."""
    return pa.array([sum(b - a for a, b in _merge([(x["start"], x["stop"]) for x in own or []])) for own in spans.to_pylist()],
                    pa.int64())


@F.arrow_udf(T.StringType())
def _digest(items: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(",".join(sorted(own or [])).encode()).hexdigest() for own in items.to_pylist()], pa.string())


def scan(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, spans (word ranges), items (ids with an occurrence)."""
    found = docs.select("doc_id", occurrences(items, "text", size, block_words).alias("hits"))
    return found.select("doc_id", "hits.n_words", "hits.spans", "hits.items")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of a scan."""
    return found.select(
        "doc_id", "n_words", _covered("spans").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        _digest("items").alias("items_sha256"), (F.size("items") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any occurrence, all columns kept."""
    mark = common.free_name(docs, "hits_")
    return docs.withColumn(mark, occurrences(items, "text", size, block_words)).filter(F.size(F.col(mark)["items"]) == 0).drop(mark)


@F.arrow_udf(T.StringType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, own in zip(texts, spans.to_pylist()):
        if not own:
            out.append(text.as_py())
            continue
        words = common.Words(pa.array([text.as_py()], pa.large_string()), CLASSES)
        data, at, kept = text.as_py().encode(), 0, []
        for a, b in _merge([(x["start"], x["stop"]) for x in own]):
            kept.append(data[at:words.start[a]])
            at = words.stop[b - 1]
        kept.append(data[at:])
        out.append(b"".join(kept).decode())
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All documents; the text from the first to the last word of each hit span is cut out."""
    mark = common.free_name(docs, "hits_")
    found = docs.withColumn(mark, occurrences(items, "text", size, block_words))
    return found.withColumn("text", _without("text", F.col(mark)["spans"])).select(*docs.columns)
