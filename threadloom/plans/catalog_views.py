"""Queries on case, entity and graph reads, edits and the audit chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.functions.chain import entry_hash, entry_payload, json_object, json_string
from threadloom.operators import audit as au
from threadloom.operators import edits as ed
from threadloom.operators import resolve as rs
from threadloom.operators import views as vw
from threadloom.operators.cutting import Workspace
from threadloom.plans.domain import Domain
from threadloom.plans.sqlbase import query
from threadloom.schema import EDGE_KEY

EDGE_OUT = ["src_case", "src_label", "src_id", "rel", "dst_case", "dst_label", "dst_id", "confidence"]


def _homes(d: Domain):
    """The cases of one region."""
    return d.table("nation").filter("n_regionkey = 1").select(F.col("n_name").alias("case_id"))


HOMES = "SELECT n_name AS case_id FROM nation WHERE n_regionkey = 1"


# ---------------------------------------------------------------- views


def view2(d: Domain):
    rows = d.trade.withColumn("case_id", F.when(F.col("n") > 2, F.lit("NATION_X")).otherwise(F.col("case_id")))
    good, bad = vw.check_cases(rows, d.cases)
    return good.withColumn("status", F.lit("accepted")).unionByName(bad.withColumn("status", F.lit("refused"))).select(
        "case_id", "c_name", "s_name", "status")


def view3(d: Domain):
    names = d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("n_name")).alias("case_id"),
        F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("  ")).otherwise(F.concat(F.lit(" Desk of "), "c_name", F.lit(" "))).alias("new_name"),
        F.col("c_custkey").alias("ord"),
    )
    changed = vw.apply_case_changes(d.cases, names)
    known = d.cases.select("case_id", F.lit(True).alias("old"))
    return changed.join(known, "case_id", "left").select(
        F.when(F.col("old"), F.col("case_id")).otherwise("created").alias("case_id"), "name")


def view6(d: Domain):
    """The first buyer of the first case."""
    top = d.buyers.orderBy("case_id", "c_custkey").select("case_id", "c_name").first()
    audit = d.edges.filter("src_label = 'Person'").select(
        F.col("src_case").alias("case_id"), F.xxhash64("dst_id").alias("seq"), F.col("dst_id").alias("ts"), F.col("rel").alias("action"),
        F.concat(F.lit('{"type": "Person", "id": "'), "src_id", F.lit('"}')).alias("details"))
    return vw.entity_detail(d.entities, d.edges, d.cases, audit, top["case_id"], "Person", top["c_name"])


VIEW6 = """
    SELECT 'property' AS section, unnest(['value', 'source', 'case_name']) AS name, NULL AS other_label, NULL AS other_id, NULL AS other_case,
           CAST(NULL AS DOUBLE) AS confidence, NULL AS ts, unnest([c_name, 'driver tables', 'Case ' || case_id]) AS text FROM me
    UNION ALL SELECT CASE WHEN i.other_case <> i.case_id THEN 'cross_' ELSE '' END || CASE direction WHEN 'out' THEN 'outgoing' ELSE 'incoming' END,
           rel, other_label, other_id, other_case, confidence, NULL, NULL FROM incident i JOIN me ON i.case_id = me.case_id AND i.label = 'Person' AND i.id = c_name
    UNION ALL SELECT 'audit', rel, NULL, NULL, NULL, NULL, dst_id, '{"type": "Person", "id": "' || src_id || '"}' FROM
        (SELECT e.* FROM edges e JOIN me ON src_case = me.case_id AND contains(src_id, c_name) WHERE src_label = 'Person' ORDER BY dst_id DESC LIMIT 10)"""
ME = "SELECT case_id, c_name FROM buyers ORDER BY case_id, c_custkey LIMIT 1"


def view9(d: Domain):
    rows = d.audit_events.select(
        F.col("action").alias("case_id"), F.col("event_id").alias("seq"), "ts", F.lit("ADD_RELATIONSHIP").alias("action"),
        F.concat(F.lit('{"type": "Phone", "from": "P'), F.col("case_id"), F.lit('"}')).alias("details"))
    return vw.audit_mentions(rows, "click", "Phone", "P7").select("case_id", "seq", "ts", "details")


def view10(d: Domain):
    return vw.case_graph_nodes(d.entities, d.edges, _homes(d))


def view11(d: Domain):
    return vw.case_graph_edges(d.edges, _homes(d))


def _drawn(d: Domain):
    links = vw.link_edges(rs.exact_links(d.entities), d.entities)
    return vw.all_graph_edges(d.edges).select("source", "target", "label", "link_type").unionByName(
        links.select("source", "target", "label", "link_type"))


ALL_DRAWN = """
    SELECT src_case || ':' || src_label || ':' || src_id AS source, dst_case || ':' || dst_label || ':' || dst_id AS target, rel AS label,
           CASE WHEN src_case <> dst_case THEN 'cross_case' ELSE 'in_case' END AS link_type, src_case, dst_case FROM edges
    UNION ALL SELECT case_a || ':' || type || ':' || id_a, case_b || ':' || type || ':' || id_b, 'SAME ' || upper(type), 'cross_case', case_a, case_b FROM exact_links"""


def view17(d: Domain):
    nodes = vw.all_graph_nodes(d.entities, d.cases)
    return vw.visible_edges(_drawn(d), nodes, _homes(d)).select("source", "target", "label", "link_type")


def view22(d: Domain):
    odd = d.edges.select(
        F.concat_ws(":", "src_case", "src_label", F.concat("src_id", F.lit(":x:y"))).alias("source"),
        F.concat_ws(":", "dst_case", "dst_label", "dst_id").alias("target"))
    return vw.decode_keys(odd, ["source", "target"]).drop("source", "target")


def view16(d: Domain):
    people = d.brand_persons
    entities = d.entity_keys.unionByName(people)
    return vw.all_analysis_edges(d.edges, entities).select("src", "dst", "rel", F.round("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------- edits


def edit1(d: Domain):
    new = d.buyers.select("case_id", F.when(F.col("c_acctbal") < 0, "Gang").otherwise("Person").alias("label"),
                          F.when(F.col("c_mktsegment") == "FURNITURE", F.lit("  ")).otherwise(F.concat(F.lit(" New "), "c_name")).alias("value"))
    return ed.add_entities(d.entities, new).select("case_id", "label", "id", "source")


def _renames(d: Domain):
    """Rich buyers get a title, poor ones a name that is taken by their market's first buyer."""
    first = d.buyers.groupBy(F.col("case_id"), "c_mktsegment").agg(F.min(F.when(F.col("c_acctbal") >= 0, F.col("c_name"))).alias("first"))
    new = F.when(F.col("c_acctbal") > 9000, F.concat(F.lit(" VIP "), "c_name")).when(F.col("c_acctbal") < 0, F.col("first"))
    return d.buyers.join(first, ["case_id", "c_mktsegment"]).select(
        "case_id", F.lit("Person").alias("label"), F.col("c_name").alias("old_id"), new.alias("new_id"),
        F.when(F.col("c_acctbal") < 0, 0).otherwise(1).cast("long").alias("ord"),  # clashing names first
    ).filter("new_id IS NOT NULL")


RENAMED = """
    SELECT case_id, c_name, CASE WHEN c_acctbal > 9000 THEN 'VIP ' || c_name WHEN c_acctbal < 0 THEN first END AS new_id, c_acctbal < 0 AS merged
    FROM buyers JOIN (SELECT case_id, c_mktsegment, min(c_name) FILTER (c_acctbal >= 0) AS first FROM buyers GROUP BY ALL) USING (case_id, c_mktsegment)
    WHERE c_acctbal > 9000 OR (c_acctbal < 0 AND first IS NOT NULL)"""
# clashing renames are merges and come first; the plain renames then follow the merged edges
RENAMED_EDGES = """
    SELECT src_case, src_label, coalesce(v.new_id, n1) AS src_id, rel, dst_case, dst_label, dst_id, sum(confidence) AS confidence FROM (
        SELECT e.*, coalesce(m.new_id, src_id) AS n1 FROM edges e
        LEFT JOIN renamed m ON m.merged AND src_label = 'Person' AND src_case = m.case_id AND src_id = m.c_name
        WHERE m.c_name IS NULL OR src_case = dst_case)
    LEFT JOIN renamed v ON NOT v.merged AND src_label = 'Person' AND src_case = v.case_id AND n1 = v.c_name GROUP BY ALL"""


def edit2(d: Domain):
    _, edges = ed.rename_entities(d.entities, d.edges, _renames(d))
    return edges.select(EDGE_OUT)


def edit3(d: Domain):
    gone = d.buyers.filter("c_acctbal < 0").select("case_id", F.lit("Person").alias("label"), F.col("c_name").alias("id"))
    markets = d.buyers.filter("c_mktsegment = 'FURNITURE'").select(
        "case_id", F.lit("Location").alias("label"), F.lit("Market FURNITURE").alias("id")).distinct()
    entities, edges = ed.delete_entities(d.entities, d.edges, gone.unionByName(markets))
    counts = entities.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n")).select("case_id", "label", "n")
    per_rel = edges.groupBy(F.col("src_case").alias("case_id"), F.col("rel").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(per_rel)


def _merges(d: Domain):
    """Per case, organisations rated poor are folded into the first well-rated one."""
    sold = d.trade.select("case_id", "s_name").distinct().join(d.sellers.select("s_name", "s_acctbal"), "s_name")
    keep = sold.groupBy("case_id").agg(F.min(F.when(F.col("s_acctbal") >= 5000, F.col("s_name"))).alias("keep_id"))
    return sold.filter("s_acctbal < 5000").join(keep, "case_id").select(
        "case_id", F.lit("Organization").alias("label"), "keep_id", F.col("s_name").alias("merge_id"))


MERGED = """
    SELECT case_id, s_name AS merge_id, keep_id FROM sold JOIN (SELECT case_id, min(s_name) FILTER (s_acctbal >= 5000) AS keep_id FROM sold GROUP BY case_id) USING (case_id)
    WHERE s_acctbal < 5000 AND keep_id IS NOT NULL"""
SOLD = "SELECT DISTINCT case_id, t.s_name, s_acctbal FROM trade t JOIN sellers s ON t.s_name = s.s_name"


def edit4(d: Domain):
    _, edges = ed.merge_entities(d.entities, d.edges, _merges(d))
    return edges.select(EDGE_OUT)


def edit4_chain(d: Domain):
    """Each organisation of a case merges into the one before it: chains end at the first."""
    sold = d.trade.select("case_id", "s_name").distinct().join(d.sellers.select("s_suppkey", "s_name"), "s_name")
    sold = Workspace(d.spark, "merges").cut(sold, "sold")
    before = sold.select("case_id", (F.col("s_suppkey") + 1).alias("s_suppkey"), F.col("s_name").alias("keep_id"))
    chain = sold.join(before, ["case_id", "s_suppkey"]).select(
        "case_id", F.lit("Organization").alias("label"), "keep_id", F.col("s_name").alias("merge_id"))
    return ed.collapse_merges(chain)


def edit5(d: Domain):
    new = d.trade.filter("n > 1").select(
        F.col("case_id").alias("src_case"), F.lit("Person").alias("src_label"), F.col("c_name").alias("src_id"),
        F.when(F.col("n") > 2, F.lit(" financial trail! ")).otherwise(F.lit("2nd deal")).alias("rel"),
        F.col("case_id").alias("dst_case"), F.lit("Organization").alias("dst_label"), F.col("s_name").alias("dst_id"))
    lost = new.withColumn("dst_label", F.lit("Vehicle"))
    blank = new.withColumn("rel", F.lit(" -- "))
    return ed.add_relationships(d.entities, d.edges, new.unionByName(lost).unionByName(blank)).select(EDGE_OUT)


def edit6(d: Domain):
    hits = d.edges.filter("rel = 'FINANCIAL_TRAIL' AND confidence > 1 OR rel = 'SPOTTED_AT'")
    new = F.when(F.col("rel") == "SPOTTED_AT", "visited place").otherwise("big deal")
    edits = hits.select(*EDGE_KEY, new.alias("new_rel"))
    there = d.edges.filter("rel = 'SPOTTED_AT' AND dst_id = 'Market BUILDING'").withColumn("rel", F.lit("VISITED_PLACE")).withColumn("confidence", F.lit(9.0))
    return ed.rename_relationships(d.edges.unionByName(there), edits).select(EDGE_OUT)


def edit7(d: Domain):
    edits = d.edges.filter("rel = 'SPOTTED_AT' OR confidence > 2").select(*EDGE_KEY).withColumn("rel", F.lower("rel"))
    return ed.delete_relationships(d.edges, edits).select(EDGE_OUT)


def edit8(d: Domain):
    spots = d.buyers.select("case_id", F.lit("Location").alias("label"), F.concat(F.lit("Market "), "c_mktsegment").alias("id"),
                            F.lit("Organization").alias("new_label")).distinct()
    cars = d.sellers.select(F.col("seller_case").alias("case_id"), F.lit("Vehicle").alias("label"), F.col("plate").alias("id"), F.lit("Phone").alias("new_label"))
    entities, edges = ed.retype_entities(d.entities, d.edges, spots.unionByName(cars))
    return edges.select(EDGE_OUT).unionByName(entities.select(
        F.col("case_id").alias("src_case"), F.col("label").alias("src_label"), F.col("id").alias("src_id"), F.lit("is").alias("rel"),
        F.col("case_id").alias("dst_case"), F.col("label").alias("dst_label"), F.col("value").alias("dst_id"), F.lit(0.0).alias("confidence")))


RETYPED = "CASE {0} WHEN 'Location' THEN 'Organization' WHEN 'Vehicle' THEN 'Phone' ELSE {0} END"


def edit9(d: Domain):
    raw = F.explode(F.array("p_name", F.concat("p_size", F.lit(" x "), "p_name"), F.concat(F.lit(" -"), "p_type", F.lit("- ")), F.lit("--"),
                            F.concat_ws("/", "p_name", "p_brand", "p_name", "p_type", "p_name", "p_brand")))
    return d.table("part").select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", tx.relationship_name(F.col("raw")).alias("rel"))


def edit10(d: Domain):
    merges = _merges(d)
    selfish = merges.withColumn("merge_id", F.col("keep_id")).distinct()
    wrong = merges.withColumn("label", F.lit("Gang"))
    absent = merges.withColumn("merge_id", F.concat(F.lit("no "), "merge_id"))
    every = merges.unionByName(selfish).unionByName(wrong).unionByName(absent)
    return ed.check_merged(every, d.entities).groupBy("case_id", F.coalesce("reason", F.lit("sound")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- audit


def _chain(d: Domain):
    """The chain of all events, stored once."""
    def build():
        empty = d.spark.createDataFrame([], au.AUDIT)
        return Workspace(d.spark, "audit").cut(au.append(empty, d.audit_events, ["ts", "event_id"]), "chain")

    return d.stored("chain", build)


def _tampered(d: Domain):
    """Details of the highest-valued events altered after hashing."""
    values = d.audit_events.select("case_id", "ts", "action", "value").groupBy("case_id", "ts", "action").agg(F.max("value").alias("value"))
    return _chain(d).join(values, ["case_id", "ts", "action"]).withColumn(
        "details", F.when(F.col("value") > 250, F.lit('{"k": -1}')).otherwise(F.col("details"))).drop("value")


def aud2_batches(d: Domain):
    """Appending in two batches gives the same chain as appending once."""
    empty = d.spark.createDataFrame([], au.AUDIT)
    early = F.col("ts") < "2024-01-15"
    first = Workspace(d.spark, "audit").cut(au.append(empty, d.audit_events.filter(early), ["ts", "event_id"]), "first")
    second = au.append(first, d.audit_events.filter(~early), ["ts", "event_id"])
    return first.unionByName(second).select("case_id", "seq", "action", "prev_hash", "hash")


def aud8(d: Domain):
    ts = F.lit("2024-02-01T00:00:00+00:00")
    manual = d.edges.filter("rel = 'INTERCEPTED_CALL' OR rel = 'OWNS_VEHICLE'")
    found = (
        au.entity_added(d.entity_keys, ts, "manual")
        .unionByName(au.relationship_found(d.edges, ts))
        .unionByName(au.call_found(d.calls, ts))
        .unionByName(au.relationship_added(manual, ts))
        .unionByName(au.entity_renamed(_renames(d).withColumn("new_id", F.trim("new_id")), ts))
        .unionByName(au.entity_deleted(d.entity_keys.filter("label = 'Location'"), ts))
        .unionByName(au.entity_merged(_merges(d), ts))
        .unionByName(au.relationship_renamed(d.edges.filter("rel = 'SPOTTED_AT'").withColumn("new_rel", F.lit("VISITED")), ts))
        .unionByName(au.relationship_deleted(manual, ts))
        .unionByName(au.entity_retyped(d.entity_keys.filter("label = 'Vehicle'").withColumn("new_label", F.lit("Phone")), ts))
    )
    return found.select("case_id", "action", "details")


AUD8 = """
    SELECT case_id, 'ADD_ENTITY' AS action, '{"id": "' || id || '", "source": "manual", "type": "' || label || '"}' AS details FROM entities
    UNION ALL SELECT src_case, 'ADD_RELATIONSHIP', '{"from": "' || src_id || '", "to": "' || dst_id || '", "type": "' || rel || '"}' FROM edges
    UNION ALL SELECT case_id, 'ADD_RELATIONSHIP', '{"duration": "' || duration_raw || '", "from": "' || caller || '", "source": "tabular_cdr", "timestamp": "'
        || ts_raw || '", "to": "' || called || '", "type": "INTERCEPTED_CALL"}' FROM calls
    UNION ALL SELECT src_case, 'ADD_RELATIONSHIP', '{"cross_case": ' || (src_case <> dst_case) || ', "from": "' || src_id || '", "source": "manual", "target_case_id": '
        || CASE WHEN src_case <> dst_case THEN '"' || dst_case || '"' ELSE 'null' END || ', "to": "' || dst_id || '", "type": "' || rel || '"}' FROM manual
    UNION ALL SELECT dst_case, 'ADD_CROSS_CASE_RELATIONSHIP', '{"from": "' || src_id || '", "source": "manual", "source_case_id": "' || src_case || '", "to": "'
        || dst_id || '", "type": "' || rel || '"}' FROM manual WHERE src_case <> dst_case
    UNION ALL SELECT case_id, 'RENAME_ENTITY', '{"from": "' || c_name || '", "to": "' || new_id || '", "type": "Person"}' FROM renamed
    UNION ALL SELECT case_id, 'DELETE_ENTITY', '{"id": "' || id || '", "type": "Location"}' FROM entities WHERE label = 'Location'
    UNION ALL SELECT case_id, 'MERGE_ENTITY', '{"kept": ' || coalesce('"' || keep_id || '"', 'null') || ', "merged_away": "' || merge_id || '", "type": "Organization"}' FROM merged
    UNION ALL SELECT src_case, 'RENAME_RELATIONSHIP', '{"cross_case": false, "from_type": "SPOTTED_AT", "source": "' || src_id || '", "target": "' || dst_id
        || '", "to_type": "VISITED"}' FROM edges WHERE rel = 'SPOTTED_AT'
    UNION ALL SELECT src_case, 'DELETE_RELATIONSHIP', '{"cross_case": ' || (src_case <> dst_case) || ', "from": "' || src_id || '", "to": "' || dst_id
        || '", "type": "' || rel || '"}' FROM manual
    UNION ALL SELECT case_id, 'CHANGE_ENTITY_TYPE', '{"from_type": "Vehicle", "id": "' || id || '", "to_type": "Phone"}' FROM entities WHERE label = 'Vehicle'"""

KEYS = {"drawn": ALL_DRAWN, "homes": HOMES}
NODE = "case_id || ':' || label || ':' || id"

ENTRIES = {
    "view1": (lambda d: vw.list_cases(d.cases, d.entities).select("case_id", "name", "entity_count"), query("""
        SELECT c.case_id, c.name, count(e.id) AS entity_count FROM cases c LEFT JOIN entities e ON e.case_id = c.case_id GROUP BY ALL""")),
    "view2": (view2, query("""
        SELECT CASE WHEN n > 2 THEN 'NATION_X' ELSE case_id END AS case_id, c_name, s_name, CASE WHEN n > 2 THEN 'refused' ELSE 'accepted' END AS status FROM trade""")),
    "view3": (view3, query("""
        SELECT c.case_id, coalesce(new_name, c.name) AS name FROM cases c LEFT JOIN (
            SELECT case_id, max_by('Desk of ' || c_name, c_custkey) AS new_name FROM buyers WHERE c_acctbal >= 0 AND c_mktsegment <> 'FURNITURE' GROUP BY case_id) x
        ON c.case_id = x.case_id
        UNION ALL SELECT 'created', 'Desk of ' || c_name FROM buyers WHERE c_acctbal < 0 AND c_mktsegment <> 'FURNITURE'""")),
    "view4": (lambda d: vw.entity_lists(d.entities, d.cases), query("""
        SELECT c.case_id, CASE label WHEN 'Person' THEN 'people' WHEN 'Location' THEN 'locations' WHEN 'Vehicle' THEN 'vehicles' WHEN 'Phone' THEN 'phones'
               WHEN 'Organization' THEN 'organizations' END AS type, id AS value, id IS NOT NULL AS is_processed
        FROM cases c LEFT JOIN entities e ON e.case_id = c.case_id""")),
    "view5": (lambda d: vw.all_entities(d.entities, d.cases), query(
        "SELECT lower(label) AS type, id AS value, e.case_id, name AS case_name FROM entities e JOIN cases c ON e.case_id = c.case_id")),
    "view6": (view6, query(VIEW6, me=ME)),
    "view7": (lambda d: vw.in_case_edges(d.edges), query("SELECT * FROM incident WHERE case_id = other_case")),
    "view8": (lambda d: vw.foreign_edges(d.edges), query("SELECT * FROM incident WHERE case_id <> other_case")),
    "view9": (view9, query("""
        SELECT action AS case_id, event_id AS seq, ts, '{"type": "Phone", "from": "P' || case_id || '"}' AS details FROM audit_events
        WHERE action = 'click' AND contains('P' || case_id, 'P7') ORDER BY ts DESC, event_id DESC LIMIT 10""")),
    "view10": (view10, query("""
        SELECT case_id AS home, label || ':' || id AS node, label || ': ' || id AS title, label AS type, NULL AS case_id FROM entities WHERE case_id IN (SELECT case_id FROM homes)
        UNION SELECT case_id, other_case || ':' || other_label || ':' || other_id, other_label || ': ' || other_id, other_label, other_case FROM incident
        WHERE case_id <> other_case AND case_id IN (SELECT case_id FROM homes)""", homes=HOMES)),
    "view11": (view11, query("""
        SELECT src_case AS home, src_label || ':' || src_id AS source, CASE WHEN dst_case <> src_case THEN dst_case || ':' ELSE '' END || dst_label || ':' || dst_id AS target,
               rel AS label, confidence, CASE WHEN dst_case <> src_case THEN 'cross_case' END AS link_type, CASE WHEN dst_case <> src_case THEN dst_case END AS case_id
        FROM edges WHERE src_case IN (SELECT case_id FROM homes)
        UNION ALL SELECT dst_case, src_case || ':' || src_label || ':' || src_id, dst_label || ':' || dst_id, rel, confidence, 'cross_case', src_case
        FROM edges WHERE src_case <> dst_case AND dst_case IN (SELECT case_id FROM homes)""", homes=HOMES)),
    "view12": (lambda d: vw.all_graph_nodes(d.entities, d.cases.filter("case_id <> 'NATION_3'")), query(f"""
        SELECT {NODE} AS node, label || ': ' || id AS title, label AS type, case_id, CASE WHEN case_id = 'NATION_3' THEN case_id ELSE 'Case ' || case_id END AS case_name
        FROM entities""")),
    "view13": (lambda d: vw.all_graph_edges(d.edges), query("""
        SELECT src_case || ':' || src_label || ':' || src_id AS source, dst_case || ':' || dst_label || ':' || dst_id AS target, rel AS label, confidence,
               src_case AS case_id, CASE WHEN src_case <> dst_case THEN 'cross_case' ELSE 'in_case' END AS link_type FROM edges""")),
    "view14": (
        lambda d: vw.link_edges(rs.cross_case_links(d.entity_keys.unionByName(d.brand_persons)), d.entity_keys.unionByName(d.brand_persons)),
        query("""
            SELECT case_a || ':' || type || ':' || id_a AS source, case_b || ':' || type || ':' || id_b AS target, 'SAME ' || upper(type) AS label,
                   'cross_case' AS link_type, 'exact' AS match_kind, CAST(NULL AS DOUBLE) AS score FROM exact_links
            UNION ALL SELECT a.case_id || ':Person:' || a.id, b.case_id || ':Person:' || b.id, 'SAME PERSON (LIKELY)', 'cross_case', 'fuzzy', CAST(100 AS DOUBLE)
            FROM persons a JOIN persons b ON lower(a.id) = lower(b.id) AND a.case_id < b.case_id""",
              persons="SELECT DISTINCT p_brand AS case_id, CASE WHEN p_type = 'ECONOMY' THEN upper(p_name) ELSE name END AS id FROM titled")),
    "view15": (lambda d: vw.case_analysis_edges(d.edges), query(
        "SELECT src_case AS graph, src_id AS src, dst_id AS dst, rel, confidence FROM edges WHERE src_case = dst_case")),
    "view16": (view16, query("""
        SELECT src, dst, rel, CAST(confidence AS DOUBLE) AS confidence FROM all_edges
        UNION ALL SELECT a.case_id || ':' || a.id, b.case_id || ':' || b.id, 'SAME_PERSON_LIKELY', CAST(1 AS DOUBLE)
        FROM persons a JOIN persons b ON lower(a.id) = lower(b.id) AND a.case_id < b.case_id""",
        persons="SELECT DISTINCT p_brand AS case_id, CASE WHEN p_type = 'ECONOMY' THEN upper(p_name) ELSE name END AS id FROM titled")),
    "view17": (view17, query("""
        SELECT source, target, label, link_type FROM drawn LEFT JOIN homes x ON x.case_id = src_case LEFT JOIN homes y ON y.case_id = dst_case
        WHERE CASE WHEN link_type = 'cross_case' THEN x.case_id IS NOT NULL OR y.case_id IS NOT NULL ELSE x.case_id IS NOT NULL AND y.case_id IS NOT NULL END""", **KEYS)),
    "view18": (lambda d: vw.search_node(vw.all_graph_nodes(d.entities, d.cases), "MARKET b").select("node", "title"), query(f"""
        SELECT {NODE} AS node, label || ': ' || id AS title FROM entities WHERE contains(lower(label || ': ' || id), 'market b') ORDER BY 1 LIMIT 1""")),
    "view19": (lambda d: vw.isolated_nodes(vw.all_graph_nodes(d.entities, d.cases), vw.all_graph_edges(d.edges.filter("rel = 'FINANCIAL_TRAIL'"))).select("node"), query(f"""
        SELECT {NODE} AS node FROM entities e WHERE NOT EXISTS (SELECT 1 FROM incident i WHERE i.case_id = e.case_id AND i.label = e.label AND i.id = e.id AND i.rel = 'FINANCIAL_TRAIL')""")),
    "view20": (lambda d: vw.parallel_rank(_drawn(d)), query("""
        SELECT source, target, label, link_type, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY source, target, label) - 1 AS pair_rank
        FROM drawn""", **KEYS)),
    "view21": (lambda d: vw.type_counts(d.entities, d.edges), query("""
        SELECT case_id, label, count(*) AS n FROM entities GROUP BY ALL UNION ALL SELECT src_case, 'Relationship', count(*) FROM edges GROUP BY ALL""")),
    "view22": (view22, query("""
        SELECT src_case AS source_case, src_label AS source_type, src_id || ':x:y' AS source_id, dst_case AS target_case, dst_label AS target_type, dst_id AS target_id FROM edges""")),
    "view23": (lambda d: vw.relationship_types(d.edges.withColumn("rel", F.when(F.col("confidence") > 2, "BIG_DEAL").otherwise(F.col("rel")))), query("""
        SELECT coalesce(o.rel, u.rel) AS rel, o.rel IS NOT NULL AS offered, coalesce(n, 0) AS n FROM
        (SELECT unnest(['ASSOCIATED_WITH', 'ASSOCIATE_OF', 'CAMERA_LOG', 'CDR_LINK', 'FINANCIAL_TRAIL', 'INTERCEPTED_CALL', 'OWNS_VEHICLE', 'SPOTTED_AT', 'USES_DEVICE']) AS rel) o
        FULL JOIN (SELECT CASE WHEN confidence > 2 THEN 'BIG_DEAL' ELSE rel END AS rel, count(*) AS n FROM edges GROUP BY 1) u ON o.rel = u.rel""")),
    "edit1": (edit1, query("""
        SELECT case_id, label, id, 'driver tables' AS source FROM entities
        UNION ALL SELECT case_id, 'Person', 'New ' || c_name, 'manual' FROM buyers WHERE c_acctbal >= 0 AND c_mktsegment <> 'FURNITURE'""")),
    "edit2": (edit2, query(RENAMED_EDGES, renamed=RENAMED)),
    "edit3": (edit3, query("""
        SELECT case_id, label, count(*) AS n FROM entities e WHERE NOT (label = 'Location' AND id = 'Market FURNITURE')
          AND NOT (label = 'Person' AND id IN (SELECT c_name FROM buyers WHERE c_acctbal < 0)) GROUP BY ALL
        UNION ALL SELECT src_case, rel, count(*) FROM edges WHERE NOT (dst_label = 'Location' AND dst_id = 'Market FURNITURE')
          AND NOT (src_label = 'Person' AND src_id IN (SELECT c_name FROM buyers WHERE c_acctbal < 0)) GROUP BY ALL""")),
    "edit4": (edit4, query("""
        SELECT src_case, src_label, src_id, rel, dst_case, dst_label, coalesce(keep_id, dst_id) AS dst_id, sum(confidence) AS confidence
        FROM edges LEFT JOIN merged ON dst_label = 'Organization' AND dst_case = case_id AND dst_id = merge_id GROUP BY ALL""", sold=SOLD, merged=MERGED)),
    "edit4_chain": (edit4_chain, query("""
        SELECT case_id, 'Organization' AS label, min(s_name) OVER (PARTITION BY case_id, run) AS keep_id, s_name AS merge_id FROM runs
        QUALIFY s_name <> min(s_name) OVER (PARTITION BY case_id, run)""",
        runs="SELECT *, s_suppkey - row_number() OVER (PARTITION BY case_id ORDER BY s_suppkey) AS run FROM (SELECT DISTINCT case_id, t.s_name, s_suppkey FROM trade t JOIN sellers s ON s.s_name = t.s_name)")),
    "edit5": (edit5, query("""
        SELECT src_case, src_label, src_id, rel, dst_case, dst_label, dst_id, sum(confidence) AS confidence FROM (
            SELECT src_case, src_label, src_id, rel, dst_case, dst_label, dst_id, confidence FROM edges
            UNION ALL SELECT case_id, 'Person', c_name, CASE WHEN n > 2 THEN 'FINANCIAL_TRAIL' ELSE 'REL_2ND_DEAL' END, case_id, 'Organization', s_name, 1.0 FROM trade WHERE n > 1)
        GROUP BY ALL""")),
    "edit6": (edit6, query("""
        SELECT src_case, src_label, src_id, CASE WHEN rel = 'SPOTTED_AT' THEN 'VISITED_PLACE' WHEN rel = 'FINANCIAL_TRAIL' AND confidence > 1 THEN 'BIG_DEAL' ELSE rel END AS rel,
               dst_case, dst_label, dst_id, confidence FROM edges""")),
    "edit7": (edit7, query("""
        SELECT src_case, src_label, src_id, rel, dst_case, dst_label, dst_id, confidence FROM edges WHERE rel <> 'SPOTTED_AT' AND confidence <= 2""")),
    "edit8": (edit8, query(f"""
        SELECT src_case, {RETYPED.format('src_label')} AS src_label, src_id, rel, dst_case, {RETYPED.format('dst_label')} AS dst_label, dst_id, confidence FROM edges
        UNION ALL SELECT case_id, {RETYPED.format('label')}, id, 'is', case_id, {RETYPED.format('label')}, id, 0.0 FROM entities""")),
    "edit9": (edit9, r"""
        SELECT p_partkey, raw, CASE WHEN core = '' THEN NULL ELSE left(CASE WHEN regexp_matches(core, '^[A-Z]') THEN core ELSE 'REL_' || core END, 60) END AS rel FROM (
            SELECT p_partkey, raw, upper(regexp_replace(regexp_replace(trim(raw), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS core FROM (
                SELECT p_partkey, unnest([p_name, p_size || ' x ' || p_name, ' -' || p_type || '- ', '--',
                    concat_ws('/', p_name, p_brand, p_name, p_type, p_name, p_brand)]) AS raw FROM part))"""),
    "edit10": (edit10, query("""
        SELECT case_id, reason, count(*) AS n FROM (
            SELECT case_id, 'sound' AS reason FROM merged UNION ALL SELECT DISTINCT case_id, 'self-merge' FROM merged
            UNION ALL SELECT case_id, 'unknown label' FROM merged UNION ALL SELECT case_id, 'not found' FROM merged) GROUP BY ALL""", sold=SOLD, merged=MERGED)),
    "aud1": (
        lambda d: d.audit_events.select("event_id", entry_hash(entry_payload(F.col("action"), F.col("details"), F.col("ts")), F.lit("GENESIS")).alias("hash")),
        query("SELECT event_id, sha256(payload || 'GENESIS') AS hash FROM payloads")),
    "aud1_text": (
        lambda d: d.table("documents").select("doc_id", F.sha2(json_object(source=json_string(F.col("source")), lang=json_string(F.col("lang"))), 256).alias("digest")),
        """SELECT doc_id, sha256('{"lang": "' || lang || '", "source": "' || source || '"}') AS digest FROM documents"""),
    "aud2": (lambda d: _chain(d), query("SELECT case_id, seq, ts, action, details, prev_hash, hash FROM chain")),
    "aud2_batches": (aud2_batches, query("SELECT case_id, seq, action, prev_hash, hash FROM chain")),
    "aud3": (lambda d: au.check_rows(_tampered(d)).select("case_id", "seq", "ok"), query("SELECT case_id, seq, value <= 250 AS ok FROM audit_events")),
    "aud4": (
        lambda d: au.verify(_tampered(d), d.table("customer").select(F.col("c_custkey").cast("string").alias("case_id"))),
        query("""
            SELECT CAST(c_custkey AS VARCHAR) AS case_id, coalesce(bool_and(value <= 250), true) AS valid, min(seq) FILTER (value > 250) AS broken_seq
            FROM customer LEFT JOIN audit_events ON case_id = CAST(c_custkey AS VARCHAR) GROUP BY c_custkey""")),
    "aud5": (
        lambda d: au.list_entries(_chain(d), "7").select("case_id", "seq", "ts", "action", "details", F.expr("variant_get(details_json, '$.k', 'bigint')").alias("k")),
        query("SELECT case_id, seq, ts, action, details, CAST(regexp_extract(details, '[0-9]+') AS BIGINT) AS k FROM audit_events WHERE case_id = '7' ORDER BY seq DESC LIMIT 200")),
    "aud6": (
        lambda d: au.list_all_entries(_chain(d)).select("case_id", "seq", "ts", "action", "details"),
        query("SELECT case_id, seq, ts, action, details FROM audit_events ORDER BY ts DESC, case_id, seq DESC LIMIT 500")),
    "aud7": (
        lambda d: au.clear(_chain(d), d.table("customer").filter("c_acctbal < 5000").select(F.col("c_custkey").cast("string").alias("case_id"))).groupBy("case_id").agg(F.count(F.lit(1)).alias("n")),
        query("SELECT case_id, count(*) AS n FROM audit_events WHERE case_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 5000) GROUP BY case_id")),
    "aud8": (aud8, query(AUD8, renamed=RENAMED, sold=SOLD,
                         merged=MERGED.replace(" AND keep_id IS NOT NULL", ""),
                         manual="SELECT * FROM edges WHERE rel IN ('INTERCEPTED_CALL', 'OWNS_VEHICLE')")),
}
