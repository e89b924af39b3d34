"""Graph jobs against brute force on small random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from threadloom.operators import analysis as an, cuts, network as nw, paths, views as vw
from threadloom.operators.upsert import entity_rows


@pytest.fixture(scope="module")
def graphs():
    rng = random.Random(5)
    out = {}
    for g in range(10):
        n, m = rng.randint(3, 12), rng.randint(2, 16)
        out[f"g{g}"] = {(f"v{rng.randrange(n):02d}", f"v{rng.randrange(n):02d}") for _ in range(m)}
    return out


@pytest.fixture(scope="module")
def edges(spark, graphs):
    rows = [(g, a, b) for g, es in graphs.items() for a, b in sorted(es)]
    return spark.createDataFrame(rows + rows[:5], "graph string, src string, dst string")


def nodes(es):
    return {v for e in es for v in e}


def clusters(es, without=None):
    left, found = nodes(es) - {without}, 0
    while left:
        found += 1
        todo = [left.pop()]
        while todo:
            at = todo.pop()
            near = {b for a, b in es if a == at} | {a for a, b in es if b == at}
            todo += near & left
            left -= near
    return found


def test_components(edges, graphs):
    got = {r.graph: r.cluster_count for r in nw.component_counts(nw.components(edges)).collect()}
    assert got == {g: clusters(es) for g, es in graphs.items()}


def test_articulation(edges, graphs):
    want = {(g, v) for g, es in graphs.items() for v in nodes(es) if clusters(es, v) > clusters(es)}
    assert {(r.graph, r.v) for r in cuts.articulation_vertices(edges).collect()} == want


def test_cycles(edges, graphs):
    def walk(es, path):
        for a, b in es:
            if a == path[-1] and b == path[0]:
                yield tuple(path + [b])
            elif a == path[-1] and b > path[0] and b not in path:
                yield from walk(es, path + [b])

    want = {(g, c) for g, es in graphs.items() for v in nodes(es) for c in walk(es, [v])}
    found = paths.cycles(edges).collect()
    assert {(r.graph, tuple(r.cycle)) for r in found} == want and len(found) == len(want)
    short = {(r.graph, tuple(r.cycle)) for r in paths.cycles(edges, max_len=2).collect()}
    assert short == {(g, c) for g, c in want if len(c) <= 3}


def distances(es, s):
    dist, count, queue = {s: 0}, {s: 1}, deque([s])
    while queue:
        v = queue.popleft()
        for a, b in es:
            if a == v and b not in dist:
                dist[b], count[b] = dist[v] + 1, 0
                queue.append(b)
            if a == v and dist[b] == dist[v] + 1:
                count[b] += count[v]
    return dist, count


def test_betweenness(edges, graphs):
    got = {(r.graph, r.v): r.betweenness for r in paths.betweenness(edges).collect()}
    for g, es in graphs.items():
        vs = nodes(es)
        far = {s: distances(es, s) for s in vs}
        for v in vs:
            total = 0.0
            for s in vs - {v}:
                for t in vs - {v, s}:
                    d, c = far[s]
                    if t in d and v in d and t in far[v][0] and d[v] + far[v][0][t] == d[t]:
                        total += c[v] * far[v][1][t] / c[t]
            n = len(vs)
            assert got[g, v] == pytest.approx(total / ((n - 1) * (n - 2)) if n > 2 else 0.0)


def test_pagerank(edges, graphs):
    rows = nw.pagerank(edges, chunk=2).collect()  # chunk 2: most vertices take the salted path
    got = {(r.graph, r.v): r.pagerank for r in rows}
    for g, es in graphs.items():
        vs = sorted(nodes(es))
        out = {v: sum(a == v for a, _ in es) for v in vs}
        rank = dict.fromkeys(vs, 1 / len(vs))
        while True:
            loose = sum(rank[v] for v in vs if not out[v])
            new = {v: 0.15 / len(vs) + 0.85 * (loose / len(vs) + sum(rank[a] / out[a] for a, b in es if b == v)) for v in vs}
            change = sum(abs(new[v] - rank[v]) for v in vs)
            rank = new
            if change < len(vs) * 1e-6:
                break
        assert sum(got[g, v] for v in vs) == pytest.approx(1)
        assert all(got[g, v] == pytest.approx(rank[v], abs=1e-12) for v in vs)
    assert all(r.converged for r in rows)


def test_degree_and_report(spark):
    star = [("g", "hub", f"leaf{i}") for i in range(6)] + [("g", "leaf0", "leaf0"), ("g", "leaf1", "hub")]
    edges = spark.createDataFrame([(*e, "FINANCIAL_TRAIL") for e in star], "graph string, src string, dst string, rel string")
    degree = {r.v: r.degree for r in nw.degrees(edges).collect()}
    assert degree["hub"] == 7 and degree["leaf0"] == 3
    persons = spark.createDataFrame([("g", v) for v in degree], "graph string, v string")
    report = {(r.kind, r.name): r.value for r in an.anomaly_report(edges, persons, connected_only=True).collect()}
    assert report == {("cycle", "leaf0 > leaf0"): 1, ("cycle", "hub > leaf1 > hub"): 2, ("high_connectivity", "hub"): 7,
                      ("cluster_count", ""): 1, ("bridge", "hub"): 1}
    apart = edges.union(spark.createDataFrame([("g", "x", "y", "CDR_LINK")], edges.schema))
    assert cuts.bridge_persons(apart, persons, connected_only=True).count() == 0
    assert cuts.bridge_persons(apart, persons, connected_only=False).count() == 1


def shuffled_rows(spark, run):
    """What ``run`` gives and the rows that its stages shuffle."""
    jvm = spark._jvm
    context = spark.sparkContext._jsc.sc()

    def written():
        stages = context.statusStore().stageList(
            jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    done = run()
    context.listenerBus().waitUntilEmpty()
    return done, written() - before


def test_betweenness_of_many_ways_into_one_vertex(spark):
    """Each source reaches the hub; no source is taken back along the ways of all others."""
    n = 600
    rows = [("g", f"s{i:03d}", "hub") for i in range(n)] + [("g", "hub", "end"), ("g", "end", "last")]
    edges = spark.createDataFrame(rows, "graph string, src string, dst string")
    got, shuffled = shuffled_rows(spark, lambda: {r.v: r.betweenness for r in paths.betweenness(edges).collect()})
    size = (n + 3 - 1) * (n + 3 - 2)
    assert got["hub"] == pytest.approx(2 * n / size) and got["end"] == pytest.approx((n + 1) / size) and got["s000"] == 0
    assert shuffled < n * n / 4


def dense(spark):
    """Every one of 30 vertices with every one of 200, and a tail."""
    rows = [("g", f"a{i:03d}", f"b{j:03d}") for i in range(30) for j in range(200)] + [("g", "b000", "t1"), ("g", "t1", "t2")]
    return spark.createDataFrame(rows, "graph string, src string, dst string"), len(rows)


def test_components_of_a_dense_graph(spark):
    edges, n = dense(spark)
    got, shuffled = shuffled_rows(spark, lambda: {r.component for r in nw.components(edges).collect()})
    assert got == {"a000"} and shuffled < 2 * n


def test_articulation_of_a_dense_graph(spark):
    edges, n = dense(spark)
    got, shuffled = shuffled_rows(spark, lambda: {r.v for r in cuts.articulation_vertices(edges).collect()})
    assert got == {"b000", "t1"} and shuffled < 4 * n


def test_holders_of_a_shared_value_in_a_ring(spark):
    """As many rows as holders, and the cut vertices of all pairs of them."""
    cases = [f"c{i:02d}" for i in range(40)]
    held = [(c, "Organization", "o") for c in cases] + [("c00", "Phone", "p"), ("c01", "Phone", "p"), ("c02", "Person", "Ann")]
    entities = entity_rows(spark.createDataFrame(held, "case_id string, label string, id string"), "t")
    stored = [(c, "Person", f"x {c}", "KNOWS", c, "Organization", "o") for c in cases[:3]] + [("c00", "Phone", "p", "KNOWS", "c02", "Person", "Ann")]
    shape = "src_case string, src_label string, src_id string, rel string, dst_case string, dst_label string, dst_id string"
    edges = spark.createDataFrame(stored, shape).withColumn("confidence", F.lit(1.0))
    rings = [(r.src, r.dst) for r in vw.all_cut_edges(edges, entities).collect()]
    pairs = [(r.src, r.dst) for r in vw.all_analysis_edges(edges, entities).collect()]
    assert len(rings) == len(stored) + 40 + 2 and len(pairs) == len(stored) + 40 * 39 // 2 + 1
    cut = lambda es: {v for v in nodes(es) if clusters(es, v) > clusters(es)}
    assert len(cut(pairs)) == 4 and cut(rings) == cut(pairs)
