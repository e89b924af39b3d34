"""Reads over cases, entities, edges and rendered graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import normalise_text
from threadloom.operators.resolve import EXACT_LABELS, cross_case_links, person_links
from threadloom.rules import RELATIONSHIP_CATALOGUE
from threadloom.schema import LABELS, NODE_KEY

LIST_NAMES = {
    "people": "Person", "locations": "Location", "vehicles": "Vehicle", "phones": "Phone",
    "organizations": "Organization",
}


# ---------------------------------------------------------------- cases


def list_cases(cases: DataFrame, entities: DataFrame) -> DataFrame:
    """Cases with their entity count, newest first. Entities are counted before the join."""
    counts = entities.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        cases.join(counts, "case_id", "left")
        .select("case_id", "name", "created_at", F.coalesce("n", F.lit(0)).alias("entity_count"))
        .orderBy(F.desc("created_at"), "case_id")
    )


def check_cases(rows: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): refused rows name an unknown case."""
    known = cases.select("case_id")
    return rows.join(known, "case_id", "left_semi"), rows.join(known, "case_id", "left_anti")


def apply_case_changes(cases: DataFrame, changes: DataFrame) -> DataFrame:
    """Renames (case_id given) and creations (case_id null); blank names are ignored.

    ``changes`` is (case_id, new_name, ord); the last rename of a case wins.
    """
    named = changes.withColumn("new_name", F.trim("new_name")).filter("new_name <> ''")
    renames = named.filter("case_id IS NOT NULL").groupBy("case_id").agg(F.max_by("new_name", "ord").alias("new_name"))
    created = named.filter("case_id IS NULL").select(
        F.expr("uuid()").alias("case_id"), F.col("new_name").alias("name"), F.current_timestamp().alias("created_at")
    )
    kept = cases.join(renames, "case_id", "left").select(
        "case_id", F.coalesce("new_name", "name").alias("name"), "created_at"
    )
    return kept.unionByName(created)


# ---------------------------------------------------------------- entities


def entity_lists(entities: DataFrame, cases: DataFrame) -> DataFrame:
    """Values by type per case, as sorted rows, and a flag for cases with any content.

    Rows rather than one record of lists, so a very large case stays spread out.
    """
    kinds = F.coalesce(*[F.when(F.col("label") == label, F.lit(name)) for name, label in LIST_NAMES.items()])
    typed = entities.filter(F.col("value").isNotNull()).select("case_id", kinds.alias("type"), "value").filter(
        "type IS NOT NULL"
    )
    return cases.select("case_id").join(typed, "case_id", "left").select(
        "case_id", "type", "value", F.col("value").isNotNull().alias("is_processed")
    ).orderBy("case_id", "type", "value")


def all_entities(entities: DataFrame, cases: DataFrame) -> DataFrame:
    """Flat list over all cases: newest case first, then type order, then value."""
    types = {"Person": "person", "Location": "location", "Vehicle": "vehicle", "Phone": "phone",
             "Organization": "organization"}
    rank = F.coalesce(*[F.when(F.col("label") == label, F.lit(i)) for i, label in enumerate(types)])
    kind = F.coalesce(*[F.when(F.col("label") == label, F.lit(name)) for label, name in types.items()])
    return (
        entities.filter(F.col("label").isin(list(types)) & F.col("value").isNotNull())
        .join(cases.select("case_id", F.col("name").alias("case_name"), "created_at"), "case_id")
        .withColumn("type_rank", rank)
        .orderBy(F.desc("created_at"), "case_id", "type_rank", "value")
        .select(kind.alias("type"), "value", "case_id", "case_name")
    )


def _side(edges: DataFrame, near: str, far: str, direction: str) -> DataFrame:
    return edges.select(
        F.col(f"{near}_case").alias("case_id"), F.col(f"{near}_label").alias("label"), F.col(f"{near}_id").alias("id"),
        F.lit(direction).alias("direction"), "rel",
        F.col(f"{far}_label").alias("other_label"), F.col(f"{far}_id").alias("other_id"),
        F.col(f"{far}_case").alias("other_case"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def incident_edges(edges: DataFrame) -> DataFrame:
    """Each edge once per end: (case_id, label, id, direction, rel, other_..., confidence)."""
    return _side(edges, "src", "dst", "out").unionByName(_side(edges, "dst", "src", "in"))


def in_case_edges(edges: DataFrame) -> DataFrame:
    return incident_edges(edges.filter("src_case = dst_case"))


def foreign_edges(edges: DataFrame) -> DataFrame:
    return incident_edges(edges.filter("src_case <> dst_case"))


def of_node(rows: DataFrame, case_id: str, label: str, node_id: str) -> DataFrame:
    return rows.filter((F.col("case_id") == case_id) & (F.col("label") == label) & (F.col("id") == node_id))


def audit_mentions(audit: DataFrame, case_id: str, label: str, node_id: str, limit: int = 10) -> DataFrame:
    """Newest audit rows of the case whose details contain both the label and the id."""
    hits = audit.filter(
        (F.col("case_id") == case_id) & F.contains("details", F.lit(label)) & F.contains("details", F.lit(node_id))
    )
    return hits.orderBy(F.desc("ts"), F.desc("seq")).limit(limit).select("case_id", "seq", "ts", "action", "details")


def entity_detail(entities: DataFrame, edges: DataFrame, cases: DataFrame, audit: DataFrame,
                  case_id: str, label: str, node_id: str) -> DataFrame:
    """Everything about one entity as tagged rows; no rows when it does not exist.

    Sections: property, outgoing, incoming, cross_outgoing, cross_incoming, audit.
    """
    if label not in LABELS:
        raise ValueError(f"unknown entity type: {label}")
    none = F.lit(None).cast("string")
    me = of_node(entities, case_id, label, node_id)
    titled = me.join(cases.select("case_id", F.col("name").alias("case_name")), "case_id", "left")
    facts = F.map_concat(
        F.coalesce("props", F.create_map().cast("map<string,string>")),
        F.create_map(
            F.lit("value"), F.coalesce("value", "id"), F.lit("source"), F.col("source"),
            F.lit("case_name"), F.coalesce("case_name", "case_id"),
        ),
    )
    own = titled.select(F.explode(facts).alias("name", "text")).select(
        F.lit("property").alias("section"), "name", none.alias("other_label"), none.alias("other_id"),
        none.alias("other_case"), F.lit(None).cast("double").alias("confidence"), none.alias("ts"), "text",
    )
    around = of_node(incident_edges(edges), case_id, label, node_id)
    side = F.when(F.col("direction") == "out", "outgoing").otherwise("incoming")
    section = F.when(F.col("other_case") == F.col("case_id"), side).otherwise(F.concat(F.lit("cross_"), side))
    linked = around.select(
        section.alias("section"), F.col("rel").alias("name"), "other_label", "other_id", "other_case", "confidence",
        none.alias("ts"), none.alias("text"),
    )
    trail = audit_mentions(audit, case_id, label, node_id).join(me.select("case_id"), "case_id", "left_semi").select(
        F.lit("audit").alias("section"), F.col("action").alias("name"), none.alias("other_label"),
        none.alias("other_id"), none.alias("other_case"), F.lit(None).cast("double").alias("confidence"), "ts",
        F.col("details").alias("text"),
    )
    return own.unionByName(linked).unionByName(trail)


# ---------------------------------------------------------------- graph views


def _key(*parts) -> Column:
    return F.concat_ws(":", *parts)


def _local_or_full(case_column: str, home: Column, label: str, node_id: str) -> Column:
    return F.when(F.col(case_column) == home, _key(label, node_id)).otherwise(_key(case_column, label, node_id))


def case_graph_edges(edges: DataFrame, homes: DataFrame) -> DataFrame:
    """Edges of each home case: outgoing ones and incoming ones from other cases."""
    cases = homes.select(F.col("case_id").alias("home"))
    out = edges.join(cases, F.col("src_case") == F.col("home"))
    back = edges.filter("src_case <> dst_case").join(cases, F.col("dst_case") == F.col("home"))
    home = F.col("home")
    both = out.unionByName(back)
    foreign = F.when(F.col("src_case") != home, F.col("src_case")).when(F.col("dst_case") != home, F.col("dst_case"))
    return both.select(
        "home",
        _local_or_full("src_case", home, "src_label", "src_id").alias("source"),
        _local_or_full("dst_case", home, "dst_label", "dst_id").alias("target"),
        F.col("rel").alias("label"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.when(foreign.isNotNull(), "cross_case").alias("link_type"), foreign.alias("case_id"),
    )


def case_graph_nodes(entities: DataFrame, edges: DataFrame, homes: DataFrame) -> DataFrame:
    """Nodes of each home case, lone ones included, plus foreign ends of its edges."""
    own = entities.filter(F.col("label").isin(LABELS)).join(homes.select("case_id"), "case_id", "left_semi").select(
        F.col("case_id").alias("home"), _key("label", "id").alias("node"),
        F.concat(F.col("label"), F.lit(": "), F.col("id")).alias("title"), F.col("label").alias("type"),
        F.lit(None).cast("string").alias("case_id"),
    )
    crossing = incident_edges(edges.filter("src_case <> dst_case")).join(
        homes.select("case_id"), "case_id", "left_semi"
    )
    foreign = crossing.select(
        F.col("case_id").alias("home"), _key("other_case", "other_label", "other_id").alias("node"),
        F.concat(F.col("other_label"), F.lit(": "), F.col("other_id")).alias("title"),
        F.col("other_label").alias("type"), F.col("other_case").alias("case_id"),
    )
    return own.unionByName(foreign).distinct()


def all_graph_nodes(entities: DataFrame, cases: DataFrame) -> DataFrame:
    nodes = entities.filter(F.col("label").isin(LABELS) & F.col("case_id").isNotNull()).select(*NODE_KEY).distinct()
    named = nodes.join(cases.select("case_id", "name"), "case_id", "left")
    return named.select(
        _key("case_id", "label", "id").alias("node"), F.concat(F.col("label"), F.lit(": "), F.col("id")).alias("title"),
        F.col("label").alias("type"), "case_id", F.coalesce("name", "case_id").alias("case_name"),
    )


def all_graph_edges(edges: DataFrame) -> DataFrame:
    known = edges.filter(
        F.col("src_label").isin(LABELS) & F.col("dst_label").isin(LABELS)
        & F.col("src_case").isNotNull() & F.col("dst_case").isNotNull()
    )
    return known.select(
        _key("src_case", "src_label", "src_id").alias("source"), _key("dst_case", "dst_label", "dst_id").alias("target"),
        F.col("rel").alias("label"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        F.col("src_case").alias("case_id"),
        F.when(F.col("src_case") != F.col("dst_case"), "cross_case").otherwise("in_case").alias("link_type"),
    )


def link_edges(links: DataFrame, entities: DataFrame) -> DataFrame:
    """Cross-case links as drawn edges; both ends must be nodes."""
    nodes = entities.select("case_id", "label", "id").distinct()
    left = nodes.toDF("case_a", "type", "id_a")
    right = nodes.toDF("case_b", "type", "id_b")
    sound = links.join(left, left.columns, "left_semi").join(right, right.columns, "left_semi")
    label = F.when(F.col("match_kind") == "fuzzy", "SAME PERSON (LIKELY)").otherwise(
        F.concat(F.lit("SAME "), F.upper("type"))
    )
    return sound.select(
        _key("case_a", "type", "id_a").alias("source"), _key("case_b", "type", "id_b").alias("target"),
        label.alias("label"), F.lit("cross_case").alias("link_type"), "match_kind", "score",
    )


def visible_nodes(nodes: DataFrame, shown: DataFrame) -> DataFrame:
    return nodes.join(shown.select("case_id"), "case_id", "left_semi")


def visible_edges(drawn: DataFrame, nodes: DataFrame, shown: DataFrame) -> DataFrame:
    """In-case edges of shown cases; cross-case edges with at least one shown end."""
    flags = nodes.select("node", "case_id").join(
        shown.select("case_id", F.lit(True).alias("on")), "case_id", "left"
    ).select("node", F.coalesce("on", F.lit(False)).alias("on"))
    src = flags.toDF("source", "src_on")
    dst = flags.toDF("target", "dst_on")
    seen = drawn.join(src, "source").join(dst, "target")
    either = (F.col("link_type") == "cross_case") & (F.col("src_on") | F.col("dst_on"))
    return seen.filter(either | (F.col("src_on") & F.col("dst_on"))).drop("src_on", "dst_on")


def search_node(nodes: DataFrame, query: str, order: str = "node") -> DataFrame:
    """First node whose title contains the query, ignoring case."""
    return nodes.filter(F.contains(F.lower("title"), F.lit(query.lower()))).orderBy(order).limit(1)


def isolated_nodes(nodes: DataFrame, drawn: DataFrame) -> DataFrame:
    ends = drawn.select(F.col("source").alias("node")).union(drawn.select(F.col("target").alias("node")))
    return nodes.join(ends, "node", "left_anti")


def parallel_rank(drawn: DataFrame) -> DataFrame:
    """Running number of each edge among those of the same unordered node pair."""
    low, high = F.least("source", "target"), F.greatest("source", "target")
    window = Window.partitionBy("low", "high").orderBy("source", "target", "label")
    return (
        drawn.withColumn("low", low).withColumn("high", high)
        .withColumn("pair_rank", F.row_number().over(window) - 1).drop("low", "high")
    )


def type_counts(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities per case and label, and edges per case under the label 'Relationship'."""
    per_label = entities.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"))
    per_case = edges.groupBy(F.col("src_case").alias("case_id")).agg(F.count(F.lit(1)).alias("n"))
    return per_label.unionByName(per_case.select("case_id", F.lit("Relationship").alias("label"), "n"))


def decode_keys(drawn: DataFrame, columns: list[str]) -> DataFrame:
    """Split case:type:id keys; later colons stay in the id."""
    out = drawn
    for c in columns:
        parts = F.split(F.col(c), ":", 3)
        for i, name in enumerate(("case", "type", "id")):
            out = out.withColumn(f"{c}_{name}", F.get(parts, F.lit(i)))
    return out


def relationship_types(edges: DataFrame) -> DataFrame:
    """Every offered or used relationship type with its edge count."""
    spark = edges.sparkSession
    offered = spark.createDataFrame([(r,) for r in RELATIONSHIP_CATALOGUE], "rel string").withColumn("offered", F.lit(True))
    used = edges.groupBy("rel").agg(F.count(F.lit(1)).alias("n"))
    return offered.join(used, "rel", "full_outer").select(
        "rel", F.coalesce("offered", F.lit(False)).alias("offered"), F.coalesce("n", F.lit(0)).alias("n")
    ).orderBy("rel")


# ---------------------------------------------------------------- analysis edge lists


def case_analysis_edges(edges: DataFrame, identity: str = "id") -> DataFrame:
    """Edges with both ends in one case, all cases at once: (graph, src, dst, rel, confidence)."""
    own = edges.filter("src_case = dst_case")
    src = F.col("src_id") if identity == "id" else _key("src_label", "src_id")
    dst = F.col("dst_id") if identity == "id" else _key("dst_label", "dst_id")
    return own.select(
        F.col("src_case").alias("graph"), src.alias("src"), dst.alias("dst"), "rel",
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )


def all_component_edges(edges: DataFrame, entities: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Edges (graph, src, dst) with the components of ``all_analysis_edges``, linear in the entities.

    All holders of a shared value, or of one spelling of a name, are linked to the smallest of
    them; names that are near each other are linked through those.
    """
    stored = edges.filter("src_case IS NOT NULL AND dst_case IS NOT NULL").select(
        _key("src_case", "src_id").alias("src"), _key("dst_case", "dst_id").alias("dst"))
    held = entities.filter(F.col("case_id").isNotNull()).select(
        "case_id", "label", "id", _key("case_id", "id").alias("v"), normalise_text(F.col("id")).alias("low"))
    value = F.when(F.col("label").isin(EXACT_LABELS), F.col("id")).when((F.col("label") == "Person") & (F.col("low") != ""), F.col("low"))
    held = held.withColumn("value", value).filter("value IS NOT NULL")
    smallest = held.groupBy("label", "value").agg(
        F.min("v").alias("least"), F.min("case_id").alias("first_case"), F.max("case_id").alias("last_case"))
    # two spellings within one case alone are not linked: only values of two cases make links
    shared = smallest.filter("first_case < last_case")
    stars = held.join(shared, ["label", "value"]).filter("v <> least").select(F.col("v").alias("src"), F.col("least").alias("dst"))
    near = person_links(entities, threshold=threshold, same_spelling=False).select(
        _key("case_a", "id_a").alias("src"), _key("case_b", "id_b").alias("dst"))
    return stored.unionByName(stars).unionByName(near).select(F.lit("all").alias("graph"), "src", "dst")


def all_cut_edges(edges: DataFrame, entities: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Edges (graph, src, dst) with the cut vertices of ``all_analysis_edges``; exact links are linear in the entities.

    The holders of a shared value are all linked in pairs there and in a ring here: either way, the others stay
    connected without any one of them.
    """
    stored = edges.filter("src_case IS NOT NULL AND dst_case IS NOT NULL").select(
        _key("src_case", "src_id").alias("src"), _key("dst_case", "dst_id").alias("dst"))
    held = entities.filter(F.col("label").isin(EXACT_LABELS) & F.col("case_id").isNotNull()).select("label", "id", "case_id").distinct()
    value = Window.partitionBy("label", "id")
    after = F.coalesce(F.lead("case_id").over(value.orderBy("case_id")), F.min("case_id").over(value))
    rings = held.withColumn("next_case", after).filter("next_case <> case_id").select(
        _key("case_id", "id").alias("src"), _key("next_case", "id").alias("dst"))
    people = person_links(entities, threshold=threshold).select(
        _key("case_a", "id_a").alias("src"), _key("case_b", "id_b").alias("dst"))
    return stored.unionByName(rings).unionByName(people).select(F.lit("all").alias("graph"), "src", "dst")


def all_analysis_edges(edges: DataFrame, entities: DataFrame, identity: str = "id", threshold: float = 85.0) -> DataFrame:
    """Stored edges of all cases plus virtual links, as one graph named 'all'."""
    both = edges.filter("src_case IS NOT NULL AND dst_case IS NOT NULL")

    def vertex(case: str, label: str, node: str) -> Column:
        return _key(case, node) if identity == "id" else _key(case, label, node)

    stored = both.select(
        vertex("src_case", "src_label", "src_id").alias("src"), vertex("dst_case", "dst_label", "dst_id").alias("dst"),
        "rel", F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )
    links = cross_case_links(entities, threshold=threshold)
    rel = F.when(F.col("match_kind") == "fuzzy", "SAME_PERSON_LIKELY").otherwise(F.concat(F.lit("SAME_"), F.upper("type")))
    virtual = links.select(
        vertex("case_a", "type", "id_a").alias("src"), vertex("case_b", "type", "id_b").alias("dst"),
        rel.alias("rel"), (F.coalesce("score", F.lit(100.0)) / 100).alias("confidence"),
    )
    return stored.unionByName(virtual).select(F.lit("all").alias("graph"), "src", "dst", "rel", "confidence")


def case_persons(entities: DataFrame) -> DataFrame:
    """Person vertices per case graph."""
    return entities.filter("label = 'Person'").select(F.col("case_id").alias("graph"), F.col("id").alias("v")).distinct()


def all_persons(entities: DataFrame) -> DataFrame:
    """Person vertices of the all-case graph."""
    return entities.filter("label = 'Person' AND case_id IS NOT NULL").select(
        F.lit("all").alias("graph"), _key("case_id", "id").alias("v")
    ).distinct()
