"""Helpers that the operators of this package share: columns of a table, words and hashes of Arrow text."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of text that a task works on at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Cut points of doc_id; a range between two is split further by equal steps.
CUTS = 1000

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; rows without an id count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def doc_ranges(table: DataFrame, per_range: int, weight: str | None = None) -> Column:
    """A number that rises with doc_id; about ``per_range`` of the summed weight (or rows) share one."""
    total = F.sum(weight) if weight else F.count(F.lit(1))
    row = table.agg(
        total.alias("total"), F.percentile_approx("doc_id", [i / CUTS for i in range(CUTS + 1)], 10 * CUTS).alias("cuts")).first()
    ranges = max(1, -(-int(row["total"] or 0) // per_range))
    points = sorted(set(row["cuts"] or []))
    keep = points if ranges >= CUTS else [points[i * len(points) // ranges] for i in range(ranges) if points]
    bounds = sorted(set(keep))
    if not bounds:
        return F.lit(-1).cast("long")
    splits = max(1, -(-ranges // CUTS))
    edges = F.array(*[F.lit(b).cast("long") for b in [*bounds, max(points[-1], bounds[-1]) + 1]])
    place = F.greatest(F.size(F.filter(edges, lambda e: e <= F.col("doc_id"))), F.lit(1))
    place = F.least(place, F.lit(len(bounds)))
    low, high = F.element_at(edges, place), F.element_at(edges, place + 1)
    step = F.least(F.greatest(F.floor((F.col("doc_id") - low) * splits / (high - low)), F.lit(0)), F.lit(splits - 1))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place.cast("long") * splits + step).cast("long")


# ---------------------------------------------------------------- Arrow text


def whole(texts: pa.Array) -> pa.Array:
    """The same rows as a large string array from offset 0, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``limit`` bytes each, or a single row."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + texts.offset + 1)[texts.offset:]
    row, rows = 0, len(texts)
    while row < rows:
        stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the row offsets into them."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + texts.offset + 1)[texts.offset:]
    data = texts.buffers()[2]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def byte_classes(word: str | None = None, gap: bytes | None = None) -> np.ndarray:
    """A table from byte to its lower-cased (A-Z) byte inside a word, 0 outside.

    ``word`` names ASCII characters of words (all others are gaps), ``gap`` the bytes between words;
    bytes of non-ASCII characters are always inside.
    """
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    if gap is not None:
        out[list(gap)] = 0
    else:
        inside = np.zeros(256, bool)
        inside[128:] = True
        inside[[ord(c) for c in word]] = True
        out[~inside] = 0
    return out


_kept_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse modulo 2 ** 64; those of a usual slice are kept."""
    global _kept_powers
    if len(_kept_powers[0]) >= n:
        return _kept_powers
    pair = []
    for base in (_PRIME, _INVERSE):
        steps = np.full(max(n, SLICE_BYTES + 16), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            pair.append(np.cumprod(steps))
    if n <= SLICE_BYTES + 16:
        _kept_powers = tuple(pair)
    return tuple(pair)


class Words:
    """Word starts, ends and 64-bit hashes of a slice of rows."""

    def __init__(self, texts: pa.Array, classes: np.ndarray):
        data, self.ends = raw(texts)
        self.low = classes[data]
        inside = self.low != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[self.ends] = True
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = inside & (~before | edge[:-1])
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        stops = inside & (~after | edge[1:])
        self.start = np.flatnonzero(starts)
        self.stop = np.flatnonzero(stops) + 1
        #: word index at which each row begins, and the row of each word
        self.first = np.searchsorted(self.start, self.ends)
        self.row = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.first))
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        power, inverse = powers(len(self.low) + 1)
        total = np.zeros(len(self.low) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * power[: len(self.low)], out=total[1:])
            value = (total[self.stop] - total[self.start]) * inverse[self.start]
        return mix(value)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Word index and hash of every run of ``k`` words inside one row."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out *= _PRIME
                out += self.hash[j:n + j]
        inside = np.flatnonzero(self.row[:n] == self.row[k - 1:])
        return inside, mix(out[inside] + np.uint64(k))

    def text(self, start: int, k: int) -> bytes:
        """Lower-cased words ``start`` to ``start + k``, joined by a space."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[start:start + k], self.stop[start:start + k]))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def id_crc(ids: np.ndarray) -> int:
    return crc32(ids.astype("<u4").tobytes())
