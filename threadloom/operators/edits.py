"""Batch edits of entities and edges. Each edit is a table; a single edit is a one-row table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.text import relationship_name, strip
from threadloom.operators.cutting import Workspace
from threadloom.operators.network import components
from threadloom.operators.upsert import add_edges, entity_rows, upsert_entities
from threadloom.schema import EDGE_COLUMNS, EDGE_KEY, LABELS, NODE_KEY

# ---------------------------------------------------------------- validation


def _known_label(column: str) -> Column:
    return F.col(column).isin(LABELS)


def _exists(edits: DataFrame, entities: DataFrame, columns: list[str], flag: str) -> DataFrame:
    keys = entities.select(*NODE_KEY).distinct().toDF(*columns).withColumn(flag, F.lit(True))
    return edits.join(keys, columns, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def check_added(edits: DataFrame) -> DataFrame:
    """Added entities with a reason, null where the edit is sound. Columns: case_id, label, value."""
    reason = F.when(~_known_label("label"), "unknown label").when(strip(F.col("value")) == "", "blank value")
    return edits.withColumn("reason", reason)


def check_renamed(edits: DataFrame, entities: DataFrame) -> DataFrame:
    """Renames (case_id, label, old_id, new_id): reason, and ``clash`` where it becomes a merge."""
    named = edits.withColumn("new_id", strip(F.col("new_id")))
    seen = _exists(named, entities, ["case_id", "label", "old_id"], "_old")
    seen = _exists(seen, entities, ["case_id", "label", "new_id"], "clash")
    reason = (
        F.when(~_known_label("label"), "unknown label").when(F.col("new_id") == "", "blank value")
        .when(~F.col("_old"), "not found")
    )
    return seen.withColumn("reason", reason).drop("_old")


def check_merged(edits: DataFrame, entities: DataFrame) -> DataFrame:
    """Merges (case_id, label, keep_id, merge_id)."""
    seen = _exists(edits, entities, ["case_id", "label", "keep_id"], "_keep")
    seen = _exists(seen, entities, ["case_id", "label", "merge_id"], "_merge")
    reason = (
        F.when(~_known_label("label"), "unknown label").when(F.col("keep_id") == F.col("merge_id"), "self-merge")
        .when(~(F.col("_keep") & F.col("_merge")), "not found")
    )
    return seen.withColumn("reason", reason).drop("_keep", "_merge")


def check_retyped(edits: DataFrame, entities: DataFrame) -> DataFrame:
    """Type changes (case_id, label, id, new_label)."""
    seen = _exists(edits, entities, ["case_id", "label", "id"], "_old")
    seen = _exists(seen, entities, ["case_id", "new_label", "id"], "_new")
    reason = (
        F.when(~(_known_label("label") & _known_label("new_label")), "unknown label")
        .when(F.col("label") == F.col("new_label"), "same type")
        .when(~F.col("_old"), "not found").when(F.col("_new"), "clash")
    )
    return seen.withColumn("reason", reason).drop("_old", "_new")


def sound(checked: DataFrame) -> DataFrame:
    return checked.filter("reason IS NULL").drop("reason")


# ---------------------------------------------------------------- entities


def add_entities(entities: DataFrame, edits: DataFrame) -> DataFrame:
    added = sound(check_added(edits)).select("case_id", "label", strip(F.col("value")).alias("id")).distinct()
    return upsert_entities(entities, entity_rows(added, "manual"))


def delete_entities(entities: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop entities (case_id, label, id) and every edge that touches one."""
    keys = gone.select(*NODE_KEY)
    src, dst = keys.toDF("src_case", "src_label", "src_id"), keys.toDF("dst_case", "dst_label", "dst_id")
    left = edges.join(src, src.columns, "left_anti").join(dst, dst.columns, "left_anti")
    return entities.join(keys, NODE_KEY, "left_anti"), left.select(*EDGE_COLUMNS)


def _mapped_ends(edges: DataFrame, mapping: DataFrame, out: list[str]) -> DataFrame:
    """Left-join a node mapping (case_id, label, id, *out) on both ends; columns get src_/dst_ names."""
    for end in ("src", "dst"):
        named = mapping.select(
            F.col("case_id").alias(f"{end}_case"), F.col("label").alias(f"{end}_label"), F.col("id").alias(f"{end}_id"),
            *[F.col(c).alias(f"{end}_{c}") for c in out],
        )
        edges = edges.join(named, [f"{end}_case", f"{end}_label", f"{end}_id"], "left")
    return edges


NODE_MOVES = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("case_id", "label", "id", "final_id")],
    T.StructField("merged", T.BooleanType()), T.StructField("via", T.ArrayType(T.StringType())),
])


def _moves_of_group(edits: pd.DataFrame) -> pd.DataFrame:
    """Final place of every id that the edits of one case and label touch, one edit after another."""
    holders: dict[str, list[str]] = {}
    for name, there in [*zip(edits["src"], edits["src_there"]), *zip(edits["dst"], edits["dst_there"])]:
        if there:
            holders[name] = [name]
    via: dict[str, list[str]] = {}
    merged: set[str] = set()
    for row in edits.sort_values(["ord", "src", "dst"], kind="stable").itertuples():
        if row.src == row.dst or row.src not in holders or (not row.rename and row.dst not in holders):
            continue
        moved = holders.pop(row.src)
        if row.dst in holders:
            merged.update(moved)
            for name in moved:
                via.setdefault(name, []).append(row.dst)
        holders.setdefault(row.dst, []).extend(moved)
    place = {name: final for final, names in holders.items() for name in names}
    rows = [(name, final, name in merged, via.get(name, [])) for name, final in place.items() if name != final or name in merged]
    out = pd.DataFrame(rows, columns=["id", "final_id", "merged", "via"])
    return out.assign(case_id=edits["case_id"].iloc[0], label=edits["label"].iloc[0])[["case_id", "label", "id", "final_id", "merged", "via"]]


def node_moves(edits: DataFrame, entities: DataFrame) -> DataFrame:
    """Where a sequence of renames and merges leaves each stored id.

    Edits are (case_id, label, src, dst, rename) and, for their order, ``ord``; without it they
    run by id. A rename onto an id that exists at its turn is a merge; an edit whose ids do not
    exist at its turn does nothing. The edits of one case and label are one sequence by
    definition, so a task replays them; only ids that edits name go there.
    """
    ordered = edits if "ord" in edits.columns else edits.withColumn("ord", F.lit(0).cast("long"))
    named = _exists(ordered.filter(_known_label("label")), entities, ["case_id", "label", "src"], "src_there")
    named = _exists(named, entities, ["case_id", "label", "dst"], "dst_there")
    return named.select("case_id", "label", "ord", "src", "dst", "rename", "src_there", "dst_there").groupBy("case_id", "label").applyInPandas(
        _moves_of_group, NODE_MOVES)


def _moved_graph(entities: DataFrame, edges: DataFrame, moves: DataFrame, keep_cross_case: bool) -> tuple[DataFrame, DataFrame]:
    """Entities and edges after ``moves``; rows that no move touches pass by without a join on their content."""
    moves = Workspace(entities.sparkSession, "edits").cut(moves, "moves")
    stays = entities.join(moves.filter("merged").select(*NODE_KEY), NODE_KEY, "left_anti").join(
        moves.filter("NOT merged").select(*NODE_KEY, "final_id"), NODE_KEY, "left")
    renamed = stays.select(
        "case_id", "label", F.coalesce("final_id", "id").alias("id"), F.coalesce("final_id", "value").alias("value"), "source", "props")
    ends = _mapped_ends(edges, moves, ["final_id", "merged", "via"])
    new_src, new_dst = F.coalesce("src_final_id", "src_id"), F.coalesce("dst_final_id", "dst_id")
    folded = F.coalesce("src_merged", F.lit(False)) | F.coalesce("dst_merged", F.lit(False))
    ends = ends.withColumns({"_src": new_src, "_dst": new_dst, "_folded": folded})
    placed = [F.col(c) for c in ("src_case", "src_label")] + [F.col("_src").alias("src_id"), F.col("rel")] + [
        F.col(c) for c in ("dst_case", "dst_label")] + [F.col("_dst").alias("dst_id")]
    plain = ["source_sentence", "last_timestamp", "last_duration"]
    kept = ends.filter("NOT _folded").select(*placed, "confidence", *plain)
    met = lambda via, *ids: F.exists(F.coalesce(via, F.array().cast("array<string>")), lambda v: v.isin(*[F.col(i) for i in ids]))
    onto_itself = (F.col("src_label") == F.col("dst_label")) & (F.col("_src") == F.col("_dst"))
    same_id = (F.col("src_label") != F.col("dst_label")) & (met(F.col("src_via"), "dst_id", "_dst") | met(F.col("dst_via"), "src_id", "_src"))
    moved = ends.filter("_folded").filter(~onto_itself & ~same_id)
    if not keep_cross_case:
        moved = moved.filter("src_case = dst_case")
    moved = moved.select(
        *placed, F.coalesce("confidence", F.lit(1.0)).alias("confidence"), *[F.lit(None).cast("string").alias(c) for c in plain])
    return renamed, _sum_moved(kept.select(*EDGE_COLUMNS), moved.select(*EDGE_COLUMNS))


def rename_entities(entities: DataFrame, edges: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Renames (case_id, label, old_id, new_id, and ``ord`` if the order matters), one after another.

    Where the new id exists by then, the two are merged.
    """
    order = ["ord"] if "ord" in edits.columns else []
    steps = edits.select("case_id", "label", *order, F.col("old_id").alias("src"), strip(F.col("new_id")).alias("dst"), F.lit(True).alias("rename"))
    return _moved_graph(entities, edges, node_moves(steps.filter("dst <> ''"), entities), False)


def collapse_merges(merges: DataFrame) -> DataFrame:
    """Chains of merges to one final target each: the kept id that is never merged away.

    The targets of a chain form one component; its final target is the member nobody merges.
    """
    work = Workspace(merges.sparkSession, "merges")
    named = work.cut(merges.select("case_id", "label", "keep_id", "merge_id").withColumn("graph", F.to_json(F.array("case_id", "label"))), "merges")
    links = named.select("graph", F.col("merge_id").alias("src"), F.col("keep_id").alias("dst"))
    labels = components(links)
    roots = labels.join(
        links.select("graph", F.col("src").alias("v")), ["graph", "v"], "left_anti"
    ).groupBy("graph", "component").agg(F.min("v").alias("keep_id"))
    member = labels.join(roots, ["graph", "component"]).select("graph", F.col("v").alias("merge_id"), "keep_id")
    return named.select("graph", "case_id", "label", "merge_id").distinct().join(
        member, ["graph", "merge_id"]
    ).select("case_id", "label", "keep_id", "merge_id")


def merge_entities(entities: DataFrame, edges: DataFrame, merges: DataFrame,
                   keep_cross_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merges (case_id, label, keep_id, merge_id, and ``ord`` if the order matters), one after another.

    Same-case edges of the merged node move to the kept one and their confidences add up (a
    missing kept one counts 0, a missing moved one 1); a neighbour whose id equals a kept id
    on the way is dropped whatever its label; cross-case edges are lost unless
    ``keep_cross_case``; only the edges that were there before keep their descriptive properties.
    A merge of an id that is gone by then, or into one, does nothing.
    """
    order = ["ord"] if "ord" in merges.columns else []
    steps = merges.select("case_id", "label", *order, F.col("merge_id").alias("src"), F.col("keep_id").alias("dst"), F.lit(False).alias("rename"))
    return _moved_graph(entities, edges, node_moves(steps, entities), keep_cross_case)


def _sum_moved(kept: DataFrame, moved: DataFrame) -> DataFrame:
    both = kept.withColumn("_moved", F.lit(False)).unionByName(moved.withColumn("_moved", F.lit(True)))
    fresh = F.max("_moved")
    total = F.sum(F.coalesce("confidence", F.lit(0.0)))
    return both.groupBy(*EDGE_KEY).agg(
        F.when(fresh, total).otherwise(F.max("confidence")).alias("confidence"),
        *[F.max(F.when(~F.col("_moved"), F.col(c))).alias(c)
          for c in ("source_sentence", "last_timestamp", "last_duration")],
    ).select(*EDGE_COLUMNS)


def retype_entities(entities: DataFrame, edges: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Type changes (case_id, label, id, new_label): edges move both ways and across cases."""
    mapping = sound(check_retyped(edits, entities)).select(*NODE_KEY, "new_label")
    changed = entities.join(mapping, NODE_KEY, "left").select(
        "case_id", F.coalesce("new_label", "label").alias("label"), "id",
        F.when(F.col("new_label").isNotNull(), F.col("id")).otherwise(F.col("value")).alias("value"), "source", "props",
    )
    ends = _mapped_ends(edges, mapping, ["new_label"])
    touched = F.col("src_new_label").isNotNull() | F.col("dst_new_label").isNotNull()
    moved = ends.filter(touched).filter("src_id <> dst_id").select(
        "src_case", F.coalesce("src_new_label", "src_label").alias("src_label"), "src_id", "rel",
        "dst_case", F.coalesce("dst_new_label", "dst_label").alias("dst_label"), "dst_id",
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.lit(None).cast("string").alias("source_sentence"),
        F.lit(None).cast("string").alias("last_timestamp"), F.lit(None).cast("string").alias("last_duration"),
    )
    return changed, _sum_moved(ends.filter(~touched).select(*EDGE_COLUMNS), moved)


# ---------------------------------------------------------------- relationships


def add_relationships(entities: DataFrame, edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits carry the edge key; each adds 1, names are made safe, both ends must exist."""
    named = edits.withColumn("rel", relationship_name(F.col("rel"))).filter("rel IS NOT NULL")
    counted = named.groupBy(*EDGE_KEY).agg(F.count(F.lit(1)).cast("double").alias("confidence"))
    for name in ("source_sentence", "last_timestamp", "last_duration"):
        counted = counted.withColumn(name, F.lit(None).cast("string"))
    return add_edges(edges, counted, entities)


def rename_relationships(edges: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (edge key, new_rel): the edge is recreated under the new name with its confidence.

    An edge that already has the new name takes over the renamed confidence.
    """
    named = edits.withColumn("rel", relationship_name(F.col("rel"))).withColumn(
        "new_rel", relationship_name(F.col("new_rel"))
    ).filter("new_rel IS NOT NULL AND rel <> new_rel")
    hit = edges.join(named.select(*EDGE_KEY, "new_rel"), EDGE_KEY, "left").withColumn(
        "_renamed", F.col("new_rel").isNotNull()
    )
    plain = [c for c in EDGE_COLUMNS if c not in EDGE_KEY and c != "confidence"]
    named_edges = hit.select(
        *[F.coalesce("new_rel", "rel").alias("rel") if c == "rel" else F.col(c) for c in EDGE_KEY],
        F.when(F.col("_renamed"), F.coalesce("confidence", F.lit(1.0))).otherwise(F.col("confidence")).alias("confidence"),
        *[F.when(~F.col("_renamed"), F.col(c)).alias(c) for c in plain], "_renamed",
    )
    order = F.struct("_renamed", "confidence")
    return named_edges.groupBy(*EDGE_KEY).agg(
        F.max_by("confidence", order).alias("confidence"), *[F.max(c).alias(c) for c in plain]
    ).select(*EDGE_COLUMNS)


def delete_relationships(edges: DataFrame, edits: DataFrame) -> DataFrame:
    named = edits.withColumn("rel", relationship_name(F.col("rel"))).select(*EDGE_KEY)
    return edges.join(named, EDGE_KEY, "left_anti").select(*EDGE_COLUMNS)
