"""Manifest, exact duplicates and spelling variants against SQL and brute force, awkward rows included."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from threadloom.llm import exact, manifest, oracle, spelling
from threadloom.operators.cutting import Workspace

from . import cases

key = lambda rows: sorted(map(repr, map(tuple, rows)))


def duck(sql, docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    return con.sql(sql)


def sourced(spark):
    """Awkward rows, many line breaks, one hot source, sources of one row and a null one."""
    docs = cases.documents(spark, [f"line {i}\nnext\n\n{cases.prose(i, 9)}" for i in range(60)])
    source = F.when(F.col("doc_id") > 128, "hot").when(F.col("doc_id") > 120, F.concat(F.lit("é"), F.col("doc_id"))).when(F.col("doc_id") > 108, "b")
    return docs.withColumn("source", source).withColumn("n_chars", F.length("text").cast("long"))


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    """The root, and per leaf the siblings of each level as (before, after)."""
    paths, nodes, below = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(nodes) > 1:
        runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
        for run in runs:
            for child in run:
                for leaf in below[child]:
                    paths[leaf].append(("".join(nodes[j] for j in run if j < child), "".join(nodes[j] for j in run if j > child)))
        nodes, below = [digest(*(nodes[j] for j in run)) for run in runs], [[x for j in run for x in below[j]] for run in runs]
    return nodes[0], paths


def proven(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest(*(field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[name] = tree([leaf(r, r.text) for r in sources[name]])
    root, upper = tree([trees[n][0] for n in names])
    out = []
    for name, over in zip(names, upper):
        for r, path in zip(sources[name], trees[name][1]):
            text = r.text
            if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            now, proof = leaf(r, text), ""
            for before, after in path + over:
                proof += before + after
                now = digest(before, now, after)
            out.append((r.doc_id, leaf(r, r.text), trees[name][0], root, digest(proof), now, now == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_brute_force(spark, levels):
    docs = sourced(spark)
    found = manifest.manifest(docs, levels).collect()
    assert key(found) == key(proven(docs.collect()))
    broken = {r.doc_id for r in found if not r.verified}
    changed = {r.doc_id for r in docs.filter(r"text like '%\n%'").collect() if zlib.crc32(str(r.doc_id).encode()) % 2 == 0}
    assert broken and broken == changed | ({3} if 3 in broken else set())


def test_manifest_equals_sql_and_takes_an_empty_table(spark):
    docs = sourced(spark).filter("doc_id is not null")
    sql = duck(oracle.OP11, docs)
    assert key(manifest.manifest(docs).select(sql.columns).collect()) == key(sql.fetchall())
    assert manifest.manifest(cases.empty(spark)).count() == 0
    single = docs.filter("doc_id = 130")
    assert key(manifest.manifest(single).collect()) == key(proven(single.collect()))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200))
def test_sweeps_visit_every_node_in_label_order(n):
    leaves = [digest(str(i)) for i in range(n)]
    nodes = manifest.rise(leaves, manifest._height(n))
    root, paths = tree(leaves)
    assert nodes[-1] == [root]
    proofs = dict(manifest.fall(nodes, None))
    assert len(proofs) == n
    for i, proof in proofs.items():
        assert manifest.folded(leaves[i], proof) == root and manifest.unpacked(manifest.packed(proof)) == proof
        assert [(b, a) for b, a in paths[i]] == [x for x in steps(proof)]


def steps(proof):
    while proof:
        yield proof[:2]
        proof = proof[2]


def test_exact_duplicates_equal_sql(spark):
    texts = ["same text"] * 40 + ["Same text", "same text ", "x" * 40_000, "x" * 40_000, "", "é", "é"] + [cases.prose(i, 12) for i in range(60)]
    docs = cases.documents(spark, texts)
    sql = duck(oracle.OP12, docs)
    found = exact.duplicates(docs)
    assert key(found.select(sql.columns).collect()) == key(sql.fetchall())
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(r.text or "" for r in rows) == sorted({r.text or "" for r in docs.collect()})
    assert {r.doc_id for r in rows} == {r.doc_id for r in found.filter("kept").collect()}
    clash = docs.withColumnsRenamed({"kind": "digest", "score": "filter_bits"})
    assert exact.deduplicate(clash).columns == clash.columns and exact.deduplicate(clash).count() == len(rows)
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    left = exact.duplicates(nameless).collect()
    assert sum(r.kept for r in left) == len(rows) and all(r.keep_id is None for r in left)
    assert exact.duplicates(cases.empty(spark)).count() == 0 and exact.deduplicate(cases.empty(spark)).count() == 0


def test_rows_without_a_twin_pass_the_filter_straight_through(spark):
    rows = spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("key"))
    rows = rows.unionByName(rows.limit(50))
    bitmaps, segments = exact.repeated_filter(rows, "key", 20_050)
    tested = exact.maybe_repeated(rows, "key", bitmaps, segments, "again")
    twins = tested.groupBy("key").count().filter("count > 1").join(tested, "key")
    assert twins.filter("not again").count() == 0 and 100 <= tested.filter("again").count() < 1_500


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@settings(max_examples=120, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=0, max_size=7), max_size=40))
def test_composition_accepts_each_pair_once(words):
    found = sorted(tuple(sorted(p)) for p in spelling.Acceptor(sorted(words)).pairs())
    assert found == sorted((a, b) for a in words for b in words if a < b and one_edit(a, b))


def test_composition_takes_very_long_words():
    assert len(list(spelling.Acceptor(["x" * 20_000, "x" * 20_001, "x" * 20_003]).pairs())) == 1


def misspelt(seed, n):
    draw = random.Random(seed)
    stems = ["harbour", "harvest", "Harbours", "quietly", "quiétly", "ÀÇÉÏÕÜ", "running", "runnings", "aaaaaaa", "aaaaaa", "aaaaab", "short", "straße×x"]
    out = []
    for _ in range(n):
        word = draw.choice(stems)
        if draw.random() < 0.4:
            i = draw.randrange(len(word))
            word = word[:i] + draw.choice(["", "e", "a", word[i] * 2]) + word[i + 1:]
        out.append(word)
    return draw.choice([" ", "-", "9"]).join(out)


def variants_by_hand(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for r in rows:
        run = ""
        for c in (r.text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c
                continue
            run = run.translate(low)
            if run:
                h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
                if h % 199 == 0:
                    p = h % len(run)
                    run = run[:p] + run[p + 1:]
                count[run] += 1
            run = ""
    count = {w: n for w, n in count.items() if n >= 5 and len(w) >= 6}
    out, form = [], {}
    for w, n in count.items():
        near = sorted((-count[x], x) for x in count if one_edit(w, x))
        form[w] = (near[0][1], -near[0][0], len(near)) if near and -near[0][0] >= 5 * n else (None, None, len(near))
    for w, n in count.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, form[w][0], root, n, form[w][2], form[w][1]))
    return out


@pytest.mark.parametrize("block", [2, 7, 20_000])
def test_variants_equal_brute_force(spark, block):
    docs = cases.documents(spark, [misspelt(i, 80) for i in range(60)])
    want = variants_by_hand(docs.collect())
    assert sum(w[1] is not None for w in want) > 20
    assert key(spelling.variants(docs, block).collect()) == key(want)


def test_variants_equal_sql_and_take_an_empty_table(spark):
    docs = cases.documents(spark, [misspelt(i, 60) for i in range(40)])
    sql = duck(oracle.OP13, docs)
    assert key(spelling.variants(docs).select(sql.columns).collect()) == key(sql.fetchall())
    assert spelling.variants(cases.empty(spark)).count() == 0


def test_pairs_of_opened_blocks_come_once(spark):
    draw = random.Random(5)
    words = {"pre" + "".join(draw.choice("ab") for _ in range(draw.randrange(3, 7))) for _ in range(60)}
    rows = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    found = spelling.near_pairs(rows, Workspace(spark, "test"), 5).collect()
    assert sorted((r.word, r.near) for r in found) == sorted((a, b) for a in words for b in words if one_edit(a, b))
