"""Merkle manifest of a table: one tree per source, one tree over the sources, and a proof for every row.

Nodes of a tree have one topological label, (last leaf below, level), and are visited by time-forward processing: a
sweep in label order takes the digests that wait for a node from a priority queue, hashes them, and sends the result
to its parent through the queue. Within a task the queue holds a few digests a level; between tasks it is a table:
the leaves of a tree are dealt to blocks of ``ARITY ** levels`` neighbours, and what a block sends above itself, its
top, is a leaf of the next sweep, so that a tree of n leaves takes log(n) / log(729) sweeps by default. The reversed sweep visits
labels downwards: each node sends every child the child's siblings followed by its own proof, so that leaves receive
whole proofs. Only digests (32 bytes) and ids are sorted and shuffled, never texts.

Defined results: leaves of one source ascend by doc_id (null first), rows that repeat an id by their digest; every row
is a leaf, repeated rows are leaves each; a row without an id counts as one whose crc32 is that of the empty text, so
its tampered text loses its line breaks too; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import common
from threadloom.operators.cutting import Workspace

ARITY = 3
#: Levels that a block spans; it has at most ARITY ** LEVELS leaves.
LEVELS = 6

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    written = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(written).cast("string"), F.lit(":"), written), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in FIELDS]).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, changed): digests of all rows, and those after tampering where they differ."""
    changed = (common.remainder("doc_id", 2) == 0) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("tree"),  # the null source comes first
        F.col("doc_id").cast("long").alias("doc_id"), _leaf(F.col("text")).alias("digest"),
        F.when(changed, _leaf(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("changed"))


def _digest(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


# ---------------------------------------------------------------- sweeps inside a block


def _height(n: int) -> int:
    """Levels above ``n`` leaves up to a single node."""
    levels = 0
    while n > ARITY ** levels:
        levels += 1
    return levels


def rise(digests: list[str], levels: int) -> list[list[str]]:
    """Digests of all nodes by level, visited in label order; the last level has one node."""
    n, nodes, queue = len(digests), [[] for _ in range(levels + 1)], []

    def send(level: int, index: int, digest: str) -> None:
        nodes[level].append(digest)
        if level < levels:
            above = index // ARITY
            last = min((above + 1) * ARITY ** (level + 1), n) - 1
            heappush(queue, (last, level + 1, index, digest))

    for leaf, digest in enumerate(digests):
        send(0, leaf, digest)
        while queue and queue[0][0] == leaf:
            _, level, index, first = heappop(queue)
            children = [first]
            while queue and queue[0][:2] == (leaf, level):
                children.append(heappop(queue)[3])
            send(level, index // ARITY, _digest(children))
    return nodes


def fall(nodes: list[list[str]], proof) -> Iterator[tuple[int, tuple]]:
    """(leaf, proof) from the last leaf to the first; a proof is (siblings before, siblings after, proof of the parent)."""
    n, top = len(nodes[0]), len(nodes) - 1
    queue = [(-(n - 1), -top, 0, proof)]
    while queue:
        _, level, index, proof = heappop(queue)
        level = -level
        if level == 0:
            yield index, proof
            continue
        below = nodes[level - 1]
        first, stop = index * ARITY, min((index + 1) * ARITY, len(below))
        for child in range(first, stop):
            own = ("".join(below[first:child]), "".join(below[child + 1:stop]), proof)
            last = min((child + 1) * ARITY ** (level - 1), n) - 1
            heappush(queue, (-last, -(level - 1), child, own))


def packed(proof) -> str:
    """A proof as text: siblings before and after, level by level."""
    parts = []
    while proof:
        before, after, proof = proof
        parts.append(f"{before}|{after};")
    return "".join(parts)


def unpacked(text: str):
    proof = None
    for part in reversed(text.split(";")[:-1]):
        before, after = part.split("|")
        proof = (before, after, proof)
    return proof


def folded(digest: str, proof) -> str:
    """The root that a leaf and its proof give."""
    while proof:
        before, after, proof = proof
        digest = sha256((before + digest + after).encode()).hexdigest()
    return digest


# ---------------------------------------------------------------- sweeps over blocks

TOPS = T.StructType([T.StructField("tree", T.StringType()), T.StructField("block", T.LongType()), T.StructField("blocks", T.LongType()),
                     T.StructField("top", T.BinaryType())])
TOPS_ARROW = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("blocks", pa.int64()), ("top", pa.binary())])


def _nodes(items: list[dict], blocks: int, levels: int) -> list[list[str]]:
    return rise([item["digest"].hex() for item in items], levels if blocks > 1 else _height(len(items)))


def _rising(levels: int):
    """Tops of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                tree, block, blocks, items = (batch.column(c)[row].as_py() for c in ("tree", "block", "blocks", "items"))
                top = _nodes(items, blocks, levels)[-1][0]
                rows.append({"tree": tree, "block": block, "blocks": blocks, "top": bytes.fromhex(top)})
            yield pa.RecordBatch.from_pylist(rows, schema=TOPS_ARROW)

    return run


PATHS = T.StructType([T.StructField("tree", T.StringType()), T.StructField("name", T.StringType()), T.StructField("at", T.LongType()),
                      T.StructField("proof", T.StringType())])
PATHS_ARROW = pa.schema([("tree", pa.string()), ("name", pa.string()), ("at", pa.int64()), ("proof", pa.string())])


def _falling(levels: int):
    """Proofs of the leaves of each block: those are blocks of the sweep below, or trees by name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                tree, blocks, items, proof = (batch.column(c)[row].as_py() for c in ("tree", "blocks", "items", "proof"))
                leaves = fall(_nodes(items, blocks, levels), unpacked(proof))
                out = [{"tree": tree, "name": items[i]["name"], "at": items[i]["at"], "proof": packed(own)} for i, own in leaves]
                yield pa.RecordBatch.from_pylist(out, schema=PATHS_ARROW)

    return run


PROVEN = T.StructType([T.StructField("doc_id", T.LongType())] + [
    T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")] + [T.StructField("verified", T.BooleanType())])
PROVEN_ARROW = pa.schema([("doc_id", pa.int64())] + [(c, pa.string()) for c in (
    "leaf", "subroot", "root", "proof_sha256", "folded_root")] + [("verified", pa.bool_())])


def _proving(levels: int):
    """Every document with its proof folded, in blocks of leaves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                blocks, items, proof, subroot, root = (batch.column(c)[row].as_py() for c in ("blocks", "items", "proof", "subroot", "root"))
                nodes = _nodes(items, blocks, levels)
                above, subroot, root = unpacked(proof), subroot.hex(), root.hex()
                shared = proof.replace("|", "").replace(";", "")
                out = []
                for i, own in fall(nodes, above):
                    item, parts, step = items[i], [], own
                    while step is not above:
                        parts += step[:2]
                        step = step[2]
                    found = folded((item["changed"] or item["digest"]).hex(), own)
                    out.append({
                        "doc_id": item["doc_id"], "leaf": nodes[0][i], "subroot": subroot, "root": root,
                        "proof_sha256": sha256(("".join(parts) + shared).encode()).hexdigest(), "folded_root": found, "verified": found == root})
                yield pa.RecordBatch.from_pylist(out, schema=PROVEN_ARROW)

    return run


def _placed(rows: DataFrame, order: list[str], levels: int, work: Workspace) -> DataFrame:
    """``rows`` with ``at``, their place in their tree, and ``blocks`` of it; ``order`` begins with the tree."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = work.cut(dealt.withColumns({"part": F.spark_partition_id(), "local": local}), "sorted")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    seen = dealt.join(F.broadcast(bases), "part").withColumn("rank", F.col("base") + F.col("local")).drop("part", "local", "base")
    trees = work.cut(seen.groupBy("tree").agg(F.min("rank").alias("first"), F.ceil(F.count(F.lit(1)) / ARITY ** levels).alias("blocks")), "sizes")
    return seen.join(trees, "tree").withColumn("at", F.col("rank") - F.col("first")).drop("rank", "first")


def _in_blocks(rows: DataFrame, names: list[str], levels: int) -> DataFrame:
    """(tree, block, blocks, items): neighbours in one row, by place."""
    dealt = rows.withColumn("block", F.floor(F.col("at") / ARITY ** levels)).repartition("tree", "block")  # a join by tree does not decide it
    return dealt.groupBy("tree", "block", "blocks").agg(F.sort_array(F.collect_list(F.struct("at", "digest", *names))).alias("items"))


def _grown(rows: DataFrame, names: list[str], levels: int, work: Workspace) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks, one per sweep upwards, and (tree, top) of all trees."""
    sweeps, roots = [work.cut(_in_blocks(rows, names, levels), "blocks")], None
    while True:
        tops = work.cut(sweeps[-1].mapInArrow(_rising(levels), TOPS), "tops")
        ended = tops.filter("blocks = 1").select("tree", "top")
        roots = ended if roots is None else roots.unionByName(ended)
        open_ = tops.filter("blocks > 1")
        if open_.isEmpty():
            return sweeps, roots
        above = open_.select("tree", F.col("block").alias("at"), F.ceil(F.col("blocks") / ARITY ** levels).alias("blocks"),
                             F.col("top").alias("digest"), F.lit(None).cast("string").alias("name"))
        sweeps.append(work.cut(_in_blocks(above, ["name"], levels), "blocks"))


def _with_proofs(sweep: DataFrame, trees: DataFrame, above: DataFrame | None) -> DataFrame:
    """Blocks with the proof of their top: of its tree where the block is whole, else from the sweep above."""
    whole = sweep.filter("blocks = 1").join(trees.select("tree", "proof"), "tree")
    if above is None:
        return whole
    parts = sweep.filter("blocks > 1").join(above.select("tree", F.col("at").alias("block"), "proof"), ["tree", "block"])
    return whole.unionByName(parts)


def _fallen(sweeps: list[DataFrame], trees: DataFrame, levels: int, work: Workspace) -> DataFrame:
    """The blocks of the lowest sweep with the proofs of their tops."""
    above = None
    for sweep in reversed(sweeps[1:]):
        above = work.cut(_with_proofs(sweep, trees, above).mapInArrow(_falling(levels), PATHS), "proofs")
    return _with_proofs(sweeps[0], trees, above)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    work = Workspace(docs.sparkSession, "manifest")
    rows = work.cut(leaves(docs), "leaves")
    sweeps, subroots = _grown(_placed(rows, ["tree", "doc_id", "digest"], levels, work), ["doc_id", "changed"], levels, work)
    named = work.cut(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest")), "subroots")
    upper, roots = _grown(_placed(named, ["tree", "name"], levels, work), ["name"], levels, work)
    proofs = work.cut(_fallen(upper, roots.withColumn("proof", F.lit("")), levels, work).mapInArrow(_falling(levels), PATHS), "source-proofs")
    rooted = named.join(roots.withColumnRenamed("top", "root"), "tree").drop("tree")
    trees = work.cut(rooted.join(proofs.select("name", "proof"), "name").select(
        F.col("name").alias("tree"), "proof", F.col("digest").alias("subroot"), "root"), "trees")
    blocks = _fallen(sweeps, trees, levels, work)
    return blocks.join(trees.drop("proof"), "tree").mapInArrow(_proving(levels), PROVEN)
