"""Near-duplicate detection by MinHash with sequential Bayesian verification.

Texts with the same shingle set form a class; only class representatives go on. Their signatures are cut into bands,
and documents that share a band are candidates:

1. every bucket links its members to its smallest one (linear in the bucket), and components are formed;
2. buckets whose members still lie in different components are searched for the pairs that step one did not try,
   leaving out pairs inside one component, which need no further link. Pairs of small buckets are made as rows; a
   bucket of more than ``SMALL`` members is dealt to pairs of tiles of at most about ``TILE_ITEMS`` shingles, and a
   task searches a tile pair in place and returns a spanning forest of its links. A pair is compared in the first
   bucket it shares. A large group of texts just under the threshold thus costs comparisons (their number grows with
   the square of the group, as the posterior cannot tell such pairs apart) but no row for each.

A candidate pair, in a row or in a tile, is compared a batch of signature values at a time and dropped as soon as the
posterior chance that its similarity reaches the threshold falls under ``MISS``; survivors are confirmed on their full
shingle sets, so every link reported is exact. With 40 bands of 5 rows a pair at similarity 0.8 misses all bands with
chance 1.3e-7.

Defined results: null texts and texts without words are empty and linked with nothing; texts of fewer than ``k``
words have their whole sequence as one shingle; rows without a doc_id have no component and are not kept; rows that
repeat an id share its component; an empty table gives no rows; extra columns are kept by ``drop_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import common
from threadloom.operators.cutting import Workspace
from threadloom.operators.network import components

#: Words of a shingle and percent of similarity, unless a caller says otherwise.
SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: Signature values compared between two looks at the posterior.
BATCH = 25
#: Posterior (or tail) chance of reaching the threshold under which a pair is dropped.
MISS = 1e-6
#: Lowest bits of the first signature values, compared before a pair is made at all.
BITS = 128
#: Members up to which a bucket's pairs are made as rows.
SMALL = 16
#: Shingles and members of a tile of a larger bucket, about; members of a tile that are compared at once.
TILE_ITEMS, TILE_ROWS, SIDE = 1 << 20, 2048, 256
#: Survivors among these from which on their intersections are counted by matrix products.
DENSE = 2000
#: Bits of the filter that comes before a join on candidate ids.
FILTER_BITS = 1 << 21

CLASSES = common.byte_classes(gap=b" \t\n\v\f\r")
_DRAWN = np.random.default_rng(20).integers(1, 1 << 63, (2, HASHES), dtype=np.uint64)
MULTIPLY, ADD = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def least_matches(n: int, percent: int) -> int:
    """Fewest of ``n`` equal values with which the posterior chance of the threshold (uniform prior) is at least MISS."""
    t, tail = percent / 100, 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if tail >= MISS:
            return m
    return n


def least_bits(percent: int) -> int:
    """Fewest equal bits of BITS that a pair at the threshold has but for chance MISS."""
    p, tail = (1 + percent / 100) / 2, 0.0
    for m in range(BITS + 1):
        tail += math.comb(BITS, m) * p ** m * (1 - p) ** (BITS - m)
        if tail >= MISS:
            return m
    return BITS


# ---------------------------------------------------------------- sketches


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): distinct shingle hashes of each row."""
    words = common.Words(texts, CLASSES)
    at, value = words.windows(k)
    rows, values = [words.row[at]], [value]
    length = np.diff(words.first)
    for j in range(1, k):
        at, value = words.windows(j)
        short = length[words.row[at]] == j
        rows.append(words.row[at][short])
        values.append(value[short])
    row, value = np.concatenate(rows), np.concatenate(values)
    with np.errstate(over="ignore"):
        key = common.mix(value + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    once = np.unique(key, return_index=True)[1]
    once = once[np.lexsort((value[once], row[once]))]
    counts = np.bincount(row[once], minlength=len(texts))
    return np.concatenate([[0], np.cumsum(counts)]), value[once]


def signatures(ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value of every hash function in each set; zeros for empty sets."""
    out, some = np.zeros((len(ends) - 1, HASHES), "<u4"), np.flatnonzero(np.diff(ends))
    if len(some):
        with np.errstate(over="ignore"):
            for i in range(HASHES):
                out[some, i] = np.minimum.reduceat((value * MULTIPLY[i] + ADD[i]) >> np.uint64(32), ends[:-1][some])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One key per row and band."""
    value = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), value.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for column in range(ROWS):
            key = key * np.uint64(0x9E3779B97F4A7C15) + value[:, :, column]
    return common.mix(key)


SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key_a", T.LongType()),
    T.StructField("key_b", T.LongType()), T.StructField("signature", T.BinaryType()),
])
SKETCH_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("signature", pa.binary())])


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, docs = common.whole(batch.column("text")), batch.column("doc_id")
            for a, b in common.slices(texts):
                ends, value = shingle_sets(texts.slice(a, b - a), k)
                n = np.diff(ends)
                some = np.flatnonzero(n)
                key = np.zeros((2, b - a), np.uint64)
                signature = signatures(ends, value)
                if len(some):
                    begin = ends[:-1][some]
                    with np.errstate(over="ignore"):
                        key[0, some] = np.add.reduceat(common.mix(value), begin)
                        key[1, some] = np.add.reduceat(common.mix(value ^ np.uint64(0x5851F42D4C957F2D)), begin)
                yield pa.RecordBatch.from_arrays([
                    docs.slice(a, b - a), pa.array(n), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)),
                    pa.array([s.tobytes() if c else None for s, c in zip(signature, n)], pa.binary())], schema=SKETCH_ARROW)

    return run


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """Per row its number of shingles, the identity of its set, and its signature."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch(k), SKETCH)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _bands(signatures: pa.Array) -> pa.Array:
    """Band keys, then the packed low bits as two numbers."""
    value = np.frombuffer(b"".join(s.as_buffer() for s in signatures), "<u4").reshape(len(signatures), HASHES)
    bits = np.packbits((value[:, :BITS] & 1).astype(np.uint8), axis=1).view(np.int64)
    rows = np.concatenate([band_keys(value).view(np.int64), bits], axis=1)
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * (BANDS + 2), pa.array(rows.reshape(-1)))


def banded(reps: DataFrame) -> DataFrame:
    """(key, band, rep, n, bits_a, bits_b): one row per band of each representative."""
    cut = reps.select("rep", "n", _bands("signature").alias("b"))
    return cut.select(
        "rep", "n", F.col("b")[BANDS].alias("bits_a"), F.col("b")[BANDS + 1].alias("bits_b"),
        F.posexplode(F.slice("b", 1, BANDS)).alias("band", "key"))


# ---------------------------------------------------------------- verification


def _may_match(left: str, right: str, percent: int) -> Column:
    """Set sizes and low bits leave room for the threshold."""
    c = lambda side, name: F.col(f"{side}.{name}")
    equal = BITS - F.bit_count(c(left, "bits_a").bitwiseXOR(c(right, "bits_a"))) - F.bit_count(c(left, "bits_b").bitwiseXOR(c(right, "bits_b")))
    return (
        (F.least(c(left, "n"), c(right, "n")) * 100 >= F.greatest(c(left, "n"), c(right, "n")) * percent)
        & (equal >= least_bits(percent))
    )


def _survives(percent: int):
    needed = [least_matches(n, percent) for n in range(BATCH, HASHES + 1, BATCH)]

    @F.arrow_udf(T.BooleanType())
    def survives(left: pa.Array, right: pa.Array) -> pa.Array:
        def table(side):
            return np.frombuffer(b"".join(s.as_buffer() for s in side), "<u4").reshape(len(side), HASHES)

        alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
        a, b = table(left), table(right)
        for step, least in enumerate(needed):
            span = slice(step * BATCH, (step + 1) * BATCH)
            matches[alive] += (a[alive, span] == b[alive, span]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        out = np.zeros(len(left), bool)
        out[alive] = True
        return pa.array(out)

    return survives


def _sets(k: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sets(texts: pa.Array) -> pa.Array:
        texts, parts = common.whole(texts), []
        for a, b in common.slices(texts):
            ends, value = shingle_sets(texts.slice(a, b - a), k)
            parts.append(pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(value.view(np.int64))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))

    return sets


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, percent: int, work: Workspace) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    side = lambda name: reps.select(F.col("rep").alias(name), F.col("signature").alias(f"sig_{name}"))
    likely = work.cut(
        pairs.join(side("a"), "a").join(side("b"), "b").filter(_survives(percent)("sig_a", "sig_b")).select("a", "b"), "likely")
    full = _full_sets(likely.select(F.explode(F.array("a", "b")).alias("wanted")), docs, k, work)
    own = lambda name: full.select(F.col("id").alias(name), F.col("items").alias(f"set_{name}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - both
    links = likely.join(own("a"), "a").join(own("b"), "b").filter(both * 100 >= union * percent)
    return links.select("a", "b").distinct()


def _maybe_in(ids: DataFrame, name: str):
    """Filter that keeps every row whose id is in ``ids`` and few others, so that the join after it moves few texts.

    A bitmap of fixed size (FILTER_BITS, 512 kB) over a hash of the ids; what it lets pass is joined exactly.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("int")
    words = ids.select(slot(name).alias("slot")).groupBy((F.col("slot") / 32).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, slot % 32)")).alias("bits")).collect()
    bitmap = np.zeros(FILTER_BITS // 32, np.int64)
    for row in words:
        bitmap[row["word"]] = row["bits"]
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf(T.BooleanType())
    def held(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at // 32] >> (at % 32)) & 1 == 1)

    return lambda c: held(F.coalesce(slot(c), F.lit(0)))


def _full_sets(ids: DataFrame, docs: DataFrame, k: int, work: Workspace) -> DataFrame:
    """(id, items): shingle sets of the documents named in the one column of ``ids``."""
    wanted = work.cut(ids.toDF("wanted").distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter(_maybe_in(wanted, "wanted")("id"))
    texts = texts.join(wanted, F.col("id") == F.col("wanted"), "left_semi")
    return work.cut(texts.select("id", _sets(k)("text").alias("items")), "sets")


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


class _Sets:
    """Shingle sets of a tile pair by dense numbers of those shingles that occur more than once."""

    def __init__(self, ends: np.ndarray, value: np.ndarray):
        self.size = np.diff(ends)
        _, element, times = np.unique(value, return_inverse=True, return_counts=True)
        often = times[element] > 1
        number = np.cumsum(times > 1) - 1
        kept = np.concatenate([[0], np.cumsum(often)])
        self.ends, self.items = kept[ends], number[element[often]]

    def one(self, row: int) -> np.ndarray:
        return self.items[self.ends[row]:self.ends[row + 1]]

    def common(self, left: int, right: int) -> int:
        return len(np.intersect1d(self.one(left), self.one(right), assume_unique=True))

    def all_common(self, left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
        """Sizes of the intersections of all of ``left`` with all of ``right``."""
        sides = []
        for rows in (left, right):
            items = [self.one(r) for r in rows]
            flat = np.concatenate(items)
            order = np.argsort(flat, kind="stable")
            sides.append((np.repeat(np.arange(len(rows)), [len(i) for i in items])[order], flat[order]))
        out = np.zeros((len(left), len(right)), np.float32)
        for start in range(0, 1 + max((int(flat[-1]) for _, flat in sides if len(flat)), default=0), width):
            parts = []
            for (row, flat), rows in zip(sides, (left, right)):
                a, b = np.searchsorted(flat, [start, start + width])
                part = np.zeros((len(rows), width), np.float32)
                part[row[a:b], flat[a:b] - start] = 1
                parts.append(part)
            out += parts[0] @ parts[1].T
        return out


class _Forest:
    """Components under the links found so far."""

    def __init__(self, names: np.ndarray):
        self.top = np.unique(names, return_inverse=True)[1]
        self.parent = list(range(len(names)))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def of(self, rows: np.ndarray) -> np.ndarray:
        known: dict[int, int] = {}
        return np.array([known.setdefault(t, self.find(t)) for t in self.top[rows].tolist()])

    def joined(self, left: int, right: int) -> bool:
        """Join two rows; whether they were apart."""
        x, y = self.find(int(self.top[left])), self.find(int(self.top[right]))
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _alive(left: np.ndarray, right: np.ndarray, sketch: np.ndarray, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs the posterior leaves, and the number of their equal values."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for step, least in enumerate(needed):
        span = slice(step * BATCH, (step + 1) * BATCH)
        matches[alive] += (sketch[left[alive], span] == sketch[right[alive], span]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    return alive, matches[alive]


def _tile_links(percent: int):
    needed = [least_matches(n, percent) for n in range(BATCH, HASHES + 1, BATCH)]

    def run(table: pa.Table) -> pa.Table:
        rep, comp, tile = (table.column(c).to_numpy() for c in ("rep", "comp", "tile"))
        low, high, band = (table.column(c)[0].as_py() for c in ("low", "high", "band"))
        items = table.column("items").combine_chunks()
        ends = np.asarray(items.offsets, np.int64)
        value = np.asarray(items.flatten()).view(np.uint64)
        ends = ends - ends[0]
        sketch, sets, forest, out = signatures(ends, value), _Sets(ends, value), _Forest(comp), []
        earlier = band_keys(sketch)[:, :band]
        sides = [np.flatnonzero(tile == t) for t in (low, high)]
        for a in range(0, len(sides[0]), SIDE):
            for b in range(a if low == high else 0, len(sides[1]), SIDE):
                left, right = sides[0][a:a + SIDE], sides[1][b:b + SIDE]
                open_ = forest.of(left)[:, None] != forest.of(right)[None, :]
                x, y = sets.size[left][:, None], sets.size[right][None, :]
                open_ &= np.minimum(x, y) * 100 >= np.maximum(x, y) * percent
                if low == high and a == b:
                    open_ = np.triu(open_, 1)
                for column in earlier.T:  # those pairs belong to a bucket before this one
                    open_ &= column[left][:, None] != column[right][None, :]
                i, j = np.nonzero(open_)
                alive, matches = _alive(left[i], right[j], sketch, needed)
                alive = alive[np.argsort(-matches, kind="stable")]
                whole = sets.all_common(left, right) if len(alive) > DENSE else None
                for p, q in zip(i[alive].tolist(), j[alive].tolist()):
                    one, two = int(left[p]), int(right[q])
                    if forest.find(int(forest.top[one])) == forest.find(int(forest.top[two])):
                        continue
                    both = sets.common(one, two) if whole is None else int(whole[p, q])
                    if both * 100 >= (sets.size[one] + sets.size[two] - both) * percent and forest.joined(one, two):
                        out.append((min(rep[one], rep[two]), max(rep[one], rep[two])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _tiled_links(rest: DataFrame, docs: DataFrame, k: int, percent: int, work: Workspace,
                 tile_items: int = TILE_ITEMS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links that join components of large buckets; rows are (key, band, rep, n, comp, size)."""
    full = _full_sets(rest.select("rep"), docs, k, work)
    tiles = rest.groupBy("key").agg(F.ceil(F.greatest(F.sum("n") / tile_items, F.count(F.lit(1)) / tile_rows)).cast("long").alias("tiles"))
    rows = rest.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = rows.select("key", "band", "rep", "comp", "tile", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"))
    held = rows.join(full, F.col("rep") == F.col("id")).drop("id")
    return held.groupBy("key", "low", "high").applyInArrow(_tile_links(percent), LINKS).distinct()


def _grouped(links: DataFrame) -> DataFrame:
    named = components(links.select(F.lit(0).alias("graph"), F.col("a").alias("src"), F.col("b").alias("dst")))
    return named.select(F.col("v").alias("rep"), F.col("component").alias("comp"))


# ---------------------------------------------------------------- operator


class _Tables(Workspace):
    """A workspace that can delete its tables by tag."""

    def __init__(self, spark, name: str):
        super().__init__(spark, name)
        self.held: dict[str, list[DataFrame]] = {}

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        table = super().cut(df, tag)
        self.held.setdefault(tag, []).append(table)
        return table

    def drop_all(self, *tags: str) -> None:
        for tag in tags:
            for table in self.held.pop(tag, []):
                self.drop(table)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id, kept."""
    work = _Tables(docs.sparkSession, "minhash")
    sketch = work.cut(sketches(docs, k), "sketches")
    known = sketch.filter("n > 0 and doc_id is not null")
    reps = work.cut(known.groupBy("key_a", "key_b").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature")), "representatives")
    members = work.cut(sketch.drop("signature"), "members")
    work.drop(sketch)
    bands = banded(reps)
    shared = bands.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1").drop("size")
    hot = work.cut(bands.join(shared, "key"), "buckets")

    leaders = hot.filter("rep = leader")
    first = leaders.alias("l").join(hot.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.rep") < F.col("r.rep"))
                                    & _may_match("l", "r", percent))
    links = work.cut(confirmed(first.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct(), reps, docs, k, percent, work), "links")
    groups = work.cut(_grouped(links), "groups")
    work.drop_all("likely", "sets", "wanted")

    placed = hot.join(groups, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.count(F.lit(1)).alias("size")).filter(
        "least < most").drop("least", "most")
    rest = work.cut(placed.join(mixed, "key"), "open")
    small = rest.filter((F.col("size") <= SMALL) & (F.col("rep") != F.col("leader")))
    second = small.alias("l").join(small.alias("r"), (
        (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") != F.col("r.comp")) & (F.col("l.rep") < F.col("r.rep")) & _may_match("l", "r", percent)))
    more = confirmed(second.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b")).distinct(), reps, docs, k, percent, work)
    more = work.cut(more.unionByName(_tiled_links(rest.filter(F.col("size") > SMALL), docs, k, percent, work)), "more-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        groups = work.cut(_grouped(links), "final-groups")

    classes = work.cut(reps.select("key_a", "key_b", "rep").join(groups, "rep", "left"), "class-components")
    work.drop_all("likely", "sets", "wanted", "buckets", "open", "links", "more-links", "groups", "final-groups", "representatives")
    rows = members.join(
        classes.withColumnsRenamed({"key_a": "own_a", "key_b": "own_b"}),
        (F.col("n") > 0) & F.col("doc_id").isNotNull() & (F.col("key_a") == F.col("own_a")) & (F.col("key_b") == F.col("own_b")), "left")
    component = F.coalesce("comp", "rep", "doc_id")
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def drop_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without those whose group has a smaller doc_id; all columns kept, rows without an id too."""
    gone = near_duplicates(docs, k, percent).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("gone_id")).distinct()
    mark = common.free_name(docs, "gone_id")
    gone = gone.withColumnRenamed("gone_id", mark)
    return docs.join(gone, docs["doc_id"] == gone[mark], "left_anti")
