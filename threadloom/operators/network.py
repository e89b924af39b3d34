"""Graph analytics as iterative joins.

Every function takes edges (graph, src, dst) and works on all graphs of the table at once: one
graph per case, or a single graph over all cases. Loops cut their lineage to durable tables and
bring only convergence counters to the driver.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from threadloom.operators.cutting import Workspace

MONEY = ["FINANCIAL_TRAIL"]


def simple_digraph(edges: DataFrame) -> DataFrame:
    """Parallel edges collapse, self-loops stay."""
    return edges.select("graph", "src", "dst").distinct()


def money_digraph(edges: DataFrame, rels: list[str] = MONEY) -> DataFrame:
    return simple_digraph(edges.filter(F.col("rel").isin(rels)))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select("graph", F.explode(F.array("src", "dst")).alias("v")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Unordered pairs (graph, u, w) with u < w; self-loops go."""
    return edges.filter("src <> dst").select(
        "graph", F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("w")
    ).distinct()


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("graph", "u", "w").unionByName(
        pairs.select("graph", F.col("w").alias("u"), F.col("u").alias("w"))
    )


# ---------------------------------------------------------------- PageRank


def pagerank(edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6,
             chunk: int = 1_000_000) -> DataFrame:
    """Unweighted PageRank per graph: (graph, v, pagerank, iterations, converged).

    A graph stops when its L1 change falls below n * tol, and keeps that iterate while others go
    on. Vertices with more than ``chunk`` out-edges have their edge list split into salts.
    """
    spark = edges.sparkSession
    work = Workspace(spark, "pagerank")
    links = work.cut(simple_digraph(edges), "links")
    outs = links.groupBy("graph", F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("outdeg"))
    nodes = vertices(links).join(outs, ["graph", "v"], "left").withColumn("outdeg", F.coalesce("outdeg", F.lit(0)))
    sizes = vertices(links).groupBy("graph").agg(F.count(F.lit(1)).alias("n"))
    salts = F.greatest(F.ceil(F.col("outdeg") / chunk), F.lit(1)).cast("int")
    hot = outs.filter(F.col("outdeg") > chunk).select("graph", F.col("v").alias("src"), salts.alias("salts"))
    salted = (
        links.join(hot, ["graph", "src"], "left")
        .withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int"))
        .select("graph", "src", "salt", "dst")
        .repartition("graph", "src", "salt")
        .persist()
    )
    ranks = work.cut(
        nodes.join(sizes, "graph").select(
            "graph", "v", "outdeg", salts.alias("salts"), "n", (1.0 / F.col("n")).alias("rank"),
            F.lit(None).cast("double").alias("delta"), F.lit(0).alias("iterations"),
        ),
        "ranks",
    )
    for _ in range(max_iter):
        state = ranks.groupBy("graph").agg(
            F.sum(F.when(F.col("outdeg") == 0, F.col("rank")).otherwise(0.0)).alias("dangling"),
            F.sum("delta").alias("change"),
        )
        sent = ranks.filter("outdeg > 0").select(
            "graph", F.col("v").alias("src"), (F.col("rank") / F.col("outdeg")).alias("share"),
            F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        )
        got = sent.join(salted, ["graph", "src", "salt"]).groupBy("graph", F.col("dst").alias("v")).agg(
            F.sum("share").alias("got")
        )
        fresh = (1 - alpha) / F.col("n") + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("dangling") / F.col("n"))
        active = F.col("change").isNull() | (F.col("change") >= F.col("n") * tol)
        moved = Observation()
        after = (
            ranks.join(got, ["graph", "v"], "left").join(state, "graph")
            .withColumn("active", active).withColumn("fresh", fresh)
            .observe(moved, F.count(F.when(F.col("active"), 1)).alias("moved"))
            .select(
                "graph", "v", "outdeg", "salts", "n",
                F.when(F.col("active"), F.col("fresh")).otherwise(F.col("rank")).alias("rank"),
                F.when(F.col("active"), F.abs(F.col("fresh") - F.col("rank"))).otherwise(0.0).alias("delta"),
                (F.col("iterations") + F.col("active").cast("int")).alias("iterations"),
            )
        )
        previous, ranks = ranks, work.cut(after, "ranks")
        work.drop(previous)
        if moved.get["moved"] == 0:
            break
    salted.unpersist()
    change = ranks.groupBy("graph").agg((F.sum("delta") < F.max("n") * tol).alias("converged"))
    return ranks.join(change, "graph").select("graph", "v", F.col("rank").alias("pagerank"), "iterations", "converged")


# ---------------------------------------------------------------- components


def numbered(work: Workspace, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices with an id over all graphs (graph, v, id), and unordered pairs of ids (u, w) without self-loops."""
    nodes = work.cut(vertices(edges).withColumn("id", F.monotonically_increasing_id()), "nodes")
    ends = edges.filter("src <> dst").select("graph", "src", "dst")
    for end, name in (("src", "_a"), ("dst", "_b")):
        ends = ends.join(nodes.select("graph", F.col("v").alias(end), F.col("id").alias(name)), ["graph", end])
    return nodes, work.cut(ends.select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("w")).distinct(), "pairs")


def contracted(work: Workspace, pairs: DataFrame) -> DataFrame:
    """Components of id pairs (u, w): (v, root) for each id of a pair, the root being one of its component.

    Randomised contraction: in each round every vertex moves onto the first of its neighbourhood in an order drawn
    anew, and the pairs are rewritten. On average at least a quarter of the vertices goes with a round, and most of
    them where vertices have many neighbours, so that the work is that of the first rounds.
    """
    draw = random.Random(7)
    moves: list[DataFrame] = []
    links, count = pairs, None
    while count != 0:
        turn = F.lit(draw.getrandbits(62))  # ids by exclusive or: another order of the same ids
        around = links.unionByName(links.select(F.col("w").alias("u"), F.col("u").alias("w")))
        first = around.groupBy(F.col("u").alias("v")).agg(F.min(F.col("w").bitwiseXOR(turn)).alias("first"))
        moved = work.cut(first.select("v", F.least("first", F.col("v").bitwiseXOR(turn)).bitwiseXOR(turn).alias("root")), "moves")
        moves.append(moved)
        rest = links.join(moved.toDF("u", "_a"), "u").join(moved.toDF("w", "_b"), "w").filter("_a <> _b")
        left = Observation()
        after = rest.select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("w")).distinct().observe(
            left, F.count(F.lit(1)).alias("n"))
        previous, links = links, work.cut(after, "links")
        if previous is not pairs:
            work.drop(previous)
        count = left.get["n"]
    roots = moves.pop()
    while moves:
        onto = roots.toDF("root", "_last")
        joined = moves[-1].join(onto, "root", "left").select("v", F.coalesce("_last", "root").alias("root"))
        roots, done = work.cut(joined, "roots"), (moves.pop(), roots)
        for table in done:
            work.drop(table)
    return roots


def components(edges: DataFrame) -> DataFrame:
    """Weak components: (graph, v, component), named by the smallest vertex."""
    work = Workspace(edges.sparkSession, "components")
    nodes, pairs = numbered(work, work.cut(edges.select("graph", "src", "dst"), "edges"))
    rooted = nodes.join(contracted(work, pairs).withColumnRenamed("v", "id"), "id", "left").withColumn(
        "root", F.coalesce("root", "id"))
    rooted = work.cut(rooted.select("graph", "v", "root"), "rooted")
    names = rooted.groupBy("root").agg(F.min("v").alias("component"))
    return rooted.join(names, "root").select("graph", "v", "component")


def component_counts(labels: DataFrame) -> DataFrame:
    return labels.select("graph", "component").distinct().groupBy("graph").agg(
        F.count(F.lit(1)).alias("cluster_count")
    )


# ---------------------------------------------------------------- degree


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out degree on the collapsed digraph; a self-loop counts twice."""
    ends = simple_digraph(edges).select("graph", F.explode(F.array("src", "dst")).alias("v"))
    return ends.groupBy("graph", "v").agg(F.count(F.lit(1)).alias("degree"))


def high_connectivity(edges: DataFrame, persons: DataFrame) -> DataFrame:
    """Persons whose degree exceeds 2 and twice the average over persons in their graph."""
    of_persons = degrees(edges).join(persons, ["graph", "v"], "left_semi")
    average = of_persons.groupBy("graph").agg(F.avg("degree").alias("average"))
    return of_persons.join(average, "graph").filter("degree > 2 * average AND degree > 2").select(
        "graph", F.col("v").alias("name"), "degree", F.round("average", 1).alias("network_average"), "average"
    )


# ---------------------------------------------------------------- ranking


def key_players(scores: DataFrame, persons: DataFrame, top_n: int = 10) -> DataFrame:
    """Best persons of each graph by PageRank; scores come from the whole graph.

    ``scores`` is (graph, v, pagerank, betweenness).
    """
    ranked = scores.join(persons, ["graph", "v"], "left_semi").withColumn(
        "place", F.row_number().over(Window.partitionBy("graph").orderBy(F.desc("pagerank"), "v"))
    )
    return ranked.filter(F.col("place") <= top_n).select(
        "graph", "place", F.col("v").alias("name"), "pagerank", "betweenness"
    )


def key_player_message(edges: DataFrame, ranked: DataFrame, graphs: DataFrame) -> DataFrame:
    """Per requested graph: why the ranking is empty, null where it is not."""
    drawn = edges.select("graph").distinct().withColumn("_drawn", F.lit(True))
    listed = ranked.select("graph").distinct().withColumn("_listed", F.lit(True))
    return graphs.join(drawn, "graph", "left").join(listed, "graph", "left").select(
        "graph",
        F.when(F.col("_drawn").isNull(), "No graph data yet. Run ingestion first.")
        .when(F.col("_listed").isNull(), "No person nodes with connections found yet.").alias("message"),
    )


def display_scores(ranked: DataFrame) -> DataFrame:
    """'#1' places and four-decimal scores."""
    return ranked.select(
        "graph", F.concat(F.lit("#"), F.col("place")).alias("position"), "name",
        F.format_number("pagerank", 4).alias("pagerank"), F.format_number("betweenness", 4).alias("betweenness"),
    )
