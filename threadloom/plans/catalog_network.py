"""Queries on graph analytics and the streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import analysis as an
from threadloom.operators import cuts, network as nw, paths
from threadloom.operators import views as vw
from threadloom.operators.cutting import Workspace
from threadloom.operators.relate import intercepted_calls
from threadloom.plans import sqlbase as sb
from threadloom.plans.domain import Domain
from threadloom.plans.sqlbase import query
from threadloom.streaming import calls as sc
from threadloom.streaming.audit import AuditStream
from threadloom.streaming.chained import ChainedStream
from threadloom.streaming.reports import ReportStream


def _cut(d: Domain, table):
    return Workspace(d.spark, "edges").cut(table, "edges")


def _call_edges(d: Domain):
    return _cut(d, nw.simple_digraph(d.call_graph))


def _closest(d: Domain):
    return _cut(d, d.closest_calls.withColumn("rel", F.lit("FINANCIAL_TRAIL")))


def _all_edges(d: Domain):
    return _cut(d, vw.all_analysis_edges(d.edges, d.entities).select("graph", "src", "dst", "rel"))


def _case_edges(d: Domain):
    return _cut(d, vw.case_analysis_edges(d.edges).select("graph", "src", "dst", "rel"))


def gr1(d: Domain):
    edges = _all_edges(d).unionByName(_case_edges(d))
    money = nw.money_digraph(edges).withColumn("kind", F.lit("money"))
    return nw.simple_digraph(edges).withColumn("kind", F.lit("all")).unionByName(money)


def gr2(d: Domain):
    return nw.pagerank(_call_edges(d)).select("graph", "v", F.round("pagerank", 9).alias("pagerank"), "iterations", "converged")


def gr3(d: Domain):
    return paths.betweenness(_call_edges(d)).select("graph", "v", F.round("betweenness", 9).alias("betweenness"))


def gr3_closest(d: Domain):
    return paths.betweenness(_closest(d)).select("graph", "v", F.round("betweenness", 9).alias("betweenness"))


def _rounded(ranked):
    return ranked.select("graph", "place", "name", F.round("pagerank", 9).alias("pagerank"), F.round("betweenness", 9).alias("betweenness"))


def gr4(d: Domain):
    return _rounded(an.key_players(_call_edges(d), d.subscribers))


def gr4_message(d: Domain):
    """Every nation plus the call cases asked for their ranking message."""
    edges = _call_edges(d)
    asked = edges.select("graph").distinct().union(d.cases.select("case_id"))
    listed = edges.filter("graph <> 'view'")
    return nw.key_player_message(edges, listed, asked)


def gr5(d: Domain):
    return _rounded(an.key_players(_all_edges(d), vw.all_persons(d.entities)))


def gr6(d: Domain):
    return paths.cycles(_cut(d, nw.money_digraph(d.main_flows))).select("graph", F.concat_ws(" > ", "cycle").alias("cycle"), "length")


def gr6_short(d: Domain):
    return paths.cycles(_cut(d, nw.money_digraph(d.nation_flows)), max_len=3).select("graph", F.concat_ws(" > ", "cycle").alias("cycle"), "length")


def gr7(d: Domain):
    everything = vw.all_component_edges(d.edges, d.entities)
    return nw.components(_closest(d).select("graph", "src", "dst").unionByName(everything))


def gr8(d: Domain):
    edges = _closest(d).unionByName(_case_edges(d))
    persons = d.subscribers.unionByName(vw.case_persons(d.entities))
    return nw.high_connectivity(edges, persons).select("graph", "name", "degree", F.round("average", 6).alias("average"))


def gr9(d: Domain):
    return cuts.bridge_persons(_case_edges(d), vw.case_persons(d.entities), connected_only=True)


def gr10(d: Domain):
    return cuts.bridge_persons(_closest(d), d.subscribers, connected_only=False)


def gr10_all(d: Domain):
    edges = _cut(d, vw.all_cut_edges(d.edges, d.entities))
    return cuts.bridge_persons(edges, vw.all_persons(d.entities), connected_only=False)


def gr11(d: Domain):
    return an.anomaly_report(_closest(d), d.subscribers, connected_only=False)


def gr12(d: Domain):
    return vw.case_persons(d.entities).unionByName(vw.all_persons(d.entities))


def gr13(d: Domain):
    return nw.display_scores(an.key_players(_call_edges(d), d.subscribers))


def _event_stream(d: Domain):
    shape = d.table("events").schema
    return d.spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(d.root)


def str1(d: Domain):
    base = Workspace(d.spark, "stream").path("calls")
    ev = _event_stream(d)
    rows = ev.select(
        F.col("event_type").alias("case_id"), F.col("event_id").alias("row_no"), F.concat(F.lit("P"), "user_id").alias("caller"),
        F.concat(F.lit("P"), F.get_json_object("props", "$.k")).alias("called"),
        F.col("ts").cast("string").alias("ts_raw"), F.col("value").cast("string").alias("duration_raw"))
    sc.write_partials(rows, f"{base}/edges", f"{base}/checkpoint").awaitTermination()
    return sc.read_edges(d.spark, f"{base}/edges").select("src_case", "src_id", "dst_id", "confidence", "last_timestamp", "last_duration")


def str2(d: Domain):
    base = Workspace(d.spark, "stream").path("reports")
    d.reports.repartition(2).write.parquet(f"{base}/input")
    stream = ReportStream(d.spark, f"{base}/store", _cut(d, d.person_names), _cut(d, d.gazetteer))
    source = d.spark.readStream.schema("case_id string, doc_id string, text string").option("maxFilesPerTrigger", 1).parquet(f"{base}/input")
    stream.start(source, f"{base}/checkpoint").awaitTermination()
    edges = stream.edges()
    return edges.groupBy("src_case", "rel").agg(F.count(F.lit(1)).alias("edge_count"), F.sum("confidence").alias("sightings"))


def str3(d: Domain):
    base = Workspace(d.spark, "stream").path("audit")
    rows = _event_stream(d).select(
        F.col("user_id").cast("string").alias("case_id"), F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("action"),
        F.col("props").alias("details"), "event_id")
    stream = AuditStream(d.spark, f"{base}/chain", ["ts", "event_id"])
    stream.start(rows, f"{base}/checkpoint").awaitTermination()
    return stream.rows().select("case_id", "seq", "action", "prev_hash", "hash")


def str3_keyed(d: Domain):
    stream = ChainedStream(d.spark, Workspace(d.spark, "stream").path("chained"), ["ts", "event_id"])
    rows = _event_stream(d).select(
        F.col("user_id").cast("string").alias("case_id"), F.col("ts").cast("string").alias("ts"), F.col("event_type").alias("action"),
        F.col("props").alias("details"), "event_id")
    stream.start(rows).awaitTermination()
    return stream.rows().select("case_id", "seq", "action", "prev_hash", "hash")


CALLS = sb.graph_ctes("call_graph")
CLOSEST = sb.graph_ctes("closest_calls")
ALL = sb.graph_ctes("all_edges")
CASE_EDGES = "SELECT src_case AS graph, src_id AS src, dst_id AS dst, rel FROM edges WHERE src_case = dst_case"
ALL_PERSONS = "SELECT 'all' AS graph, case_id || ':' || id AS v FROM entities WHERE label = 'Person'"
CASE_PERSONS = "SELECT case_id AS graph, id AS v FROM entities WHERE label = 'Person'"


def _players(persons: str) -> str:
    return f"""
        SELECT graph, row_number() OVER (PARTITION BY graph ORDER BY rank DESC, v) AS place, v AS name, round(rank, 9) AS pagerank,
               round(betweenness, 9) AS betweenness
        FROM final_rank JOIN between USING (graph, v) SEMI JOIN {persons} p USING (graph, v)
        QUALIFY row_number() OVER (PARTITION BY graph ORDER BY rank DESC, v) <= 10"""


DEGREE = """
    SELECT graph, v, count(*) AS degree FROM (SELECT graph, src AS v FROM ge UNION ALL SELECT graph, dst FROM ge)
    SEMI JOIN persons p USING (graph, v) GROUP BY graph, v"""
HIGH = """
    SELECT graph, v AS name, degree, avg(degree) OVER (PARTITION BY graph) AS average FROM degree
    QUALIFY degree > 2 * avg(degree) OVER (PARTITION BY graph) AND degree > 2"""
CUT_PARTS = {**sb.LABELS, **sb.CUTS}

ENTRIES = {
    "gr1": (gr1, query("""
        SELECT DISTINCT graph, src, dst, 'all' AS kind FROM (SELECT graph, src, dst FROM all_edges UNION ALL SELECT graph, src, dst FROM case_edges)
        UNION ALL SELECT DISTINCT graph, src, dst, 'money' FROM (SELECT graph, src, dst, rel FROM all_edges UNION ALL SELECT graph, src, dst, rel FROM case_edges)
        WHERE rel = 'FINANCIAL_TRAIL'""", case_edges=CASE_EDGES)),
    "gr2": (gr2, query("SELECT graph, v, round(rank, 9) AS pagerank, it AS iterations, true AS converged FROM final_rank", **CALLS, **sb.PAGERANK)),
    "gr3": (gr3, query("SELECT graph, v, round(betweenness, 9) AS betweenness FROM between", **CALLS, **sb.betweenness_ctes(10))),
    "gr3_closest": (gr3_closest, query("SELECT graph, v, round(betweenness, 9) AS betweenness FROM between", **CLOSEST, **{**sb.betweenness_ctes(0), **sb.SINGLE_WALK})),
    "gr4": (gr4, query(_players("subscribers"), **CALLS, **sb.PAGERANK, **sb.betweenness_ctes(10))),
    "gr4_message": (gr4_message, query("""
        SELECT DISTINCT graph, CASE WHEN graph = 'view' THEN 'No person nodes with connections found yet.' END AS message FROM call_graph
        UNION ALL SELECT case_id, 'No graph data yet. Run ingestion first.' FROM cases""")),
    "gr5": (gr5, query(_players("persons"), **ALL, **sb.PAGERANK, **sb.betweenness_ctes(10), persons=ALL_PERSONS)),
    "gr6": (gr6, query("SELECT graph, array_to_string(cycle, ' > ') AS cycle, length FROM cyc", **sb.graph_ctes("main_flows"), **sb.cycle_ctes(None))),
    "gr6_short": (gr6_short, query("SELECT graph, array_to_string(cycle, ' > ') AS cycle, length FROM cyc", **sb.graph_ctes("nation_flows"), **sb.cycle_ctes(3))),
    "gr7": (gr7, query("SELECT graph, v, component FROM comp", **sb.graph_ctes("both_edges"), **sb.LABELS,
                       both_edges="SELECT graph, src, dst FROM closest_calls UNION ALL SELECT graph, src, dst FROM all_edges")),
    "gr8": (gr8, query("SELECT graph, name, degree, round(average, 6) AS average FROM high", **sb.graph_ctes("both_edges"), degree=DEGREE, high=HIGH,
                       both_edges="SELECT graph, src, dst FROM closest_calls UNION ALL SELECT graph, src, dst FROM case_edges", case_edges=CASE_EDGES,
                       persons=f"SELECT graph, v FROM subscribers UNION ALL {CASE_PERSONS}")),
    "gr9": (gr9, query("""
        SELECT graph, v FROM cut_vertices SEMI JOIN persons p USING (graph, v)
        SEMI JOIN (SELECT graph FROM comp GROUP BY graph HAVING count(DISTINCT component) = 1 AND count(*) > 2) w USING (graph)""",
        **sb.graph_ctes("case_edges"), **CUT_PARTS, case_edges=CASE_EDGES, persons=CASE_PERSONS)),
    "gr10": (gr10, query("SELECT graph, v FROM cut_vertices SEMI JOIN subscribers p USING (graph, v)", **CLOSEST, **CUT_PARTS)),
    "gr10_all": (gr10_all, None),
    "gr11": (gr11, query("""
        SELECT graph, 'cycle' AS kind, array_to_string(cycle, ' > ') AS name, CAST(length AS DOUBLE) AS value FROM cyc
        UNION ALL SELECT graph, 'high_connectivity', name, CAST(degree AS DOUBLE) FROM high
        UNION ALL SELECT graph, 'cluster_count', '', CAST(count(DISTINCT component) AS DOUBLE) FROM comp GROUP BY graph
        UNION ALL SELECT graph, 'bridge', v, CAST(1 AS DOUBLE) FROM cut_vertices SEMI JOIN subscribers p USING (graph, v)""",
        **CLOSEST, **CUT_PARTS, **sb.cycle_ctes(None), persons="SELECT * FROM subscribers", degree=DEGREE, high=HIGH)),
    "gr12": (gr12, query(f"{CASE_PERSONS} UNION ALL {ALL_PERSONS}")),
    "gr13": (gr13, query(f"""
        SELECT graph, '#' || place AS position, name, format('{{:.4f}}', pagerank) AS pagerank, format('{{:.4f}}', betweenness) AS betweenness
        FROM ({_players('subscribers')})""", **CALLS, **sb.PAGERANK, **sb.betweenness_ctes(10))),
    "str1": (str1, query("""
        SELECT case_id AS src_case, caller AS src_id, called AS dst_id, CAST(count(*) AS DOUBLE) AS confidence,
               max_by(ts_raw, row_no) AS last_timestamp, max_by(duration_raw, row_no) AS last_duration FROM calls GROUP BY ALL""")),
    "str2": (str2, query("""
        SELECT src_case, rel, count(*) AS edge_count, CAST(sum(n) AS DOUBLE) AS sightings FROM (
            SELECT case_id AS src_case, rel, src_label, src_id, dst_label, dst_id, count(*) AS n FROM sightings GROUP BY ALL) GROUP BY ALL""")),
    "str3": (str3, query("SELECT case_id, seq, action, prev_hash, hash FROM chain")),
    "str3_keyed": (str3_keyed, query("SELECT case_id, seq, action, prev_hash, hash FROM chain")),
}
