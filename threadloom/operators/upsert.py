"""Batch upserts, clears and deletes of entities and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.schema import EDGE_COLUMNS, EDGE_KEY, LABELS, NODE_KEY


def entity_rows(found: DataFrame, source: str) -> DataFrame:
    """(case_id, label, id) rows as full entity rows with their display value."""
    return found.select(
        *NODE_KEY, F.col("id").alias("value"), F.lit(source).alias("source"),
        F.create_map().cast("map<string,string>").alias("props"),
    )


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per key; the newer display value and source win, old properties stay."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    return both.groupBy(*NODE_KEY).agg(
        F.max_by("value", "_gen").alias("value"),
        F.max_by("source", "_gen").alias("source"),
        F.min_by("props", "_gen").alias("props"),
    )


def with_both_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose two ends are stored entities."""
    keys = entities.select(*NODE_KEY)
    src = keys.toDF("src_case", "src_label", "src_id")
    dst = keys.toDF("dst_case", "dst_label", "dst_id")
    return edges.join(src, src.columns, "left_semi").join(dst, dst.columns, "left_semi").select(*edges.columns)


def latest(value: str, order: str | Column) -> Column:
    """Last non-blank value by order."""
    seen = F.when(F.col(value) != "", F.struct(F.col(order).alias("o") if isinstance(order, str) else order.alias("o"),
                                               F.col(value).alias("v")))
    return F.max(seen)["v"].alias(value)


def accumulate(sightings: DataFrame) -> DataFrame:
    """Sightings to edges: confidence counts them, the last sentence, time and duration win.

    Sightings carry the edge key, ``ord``, any of the three descriptive columns and maybe ``n``, how many a row stands for.
    """
    described = ["source_sentence", "last_timestamp", "last_duration"]
    for name in described:
        if name not in sightings.columns:
            sightings = sightings.withColumn(name, F.lit(None).cast("string"))
    seen = F.sum("n") if "n" in sightings.columns else F.count(F.lit(1))
    return sightings.groupBy(*EDGE_KEY).agg(
        seen.cast("double").alias("confidence"), *[latest(n, "ord") for n in described]
    ).select(*EDGE_COLUMNS)


def add_edges(old: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """Merge accumulated new edges into stored ones; confidence adds up.

    New edges with a missing end are dropped silently.
    """
    both = old.select(*EDGE_COLUMNS).withColumn("_gen", F.lit(0)).unionByName(
        with_both_ends(new.select(*EDGE_COLUMNS), entities).withColumn("_gen", F.lit(1))
    )
    return both.groupBy(*EDGE_KEY).agg(
        F.sum(F.coalesce("confidence", F.lit(0.0))).alias("confidence"),
        *[latest(n, "_gen") for n in ("source_sentence", "last_timestamp", "last_duration")],
    ).select(*EDGE_COLUMNS)


def replace_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Replacing upsert: the last row per key wins; zero or missing confidence becomes 1."""
    last = relations.groupBy(*EDGE_KEY).agg(
        F.max_by(F.struct("confidence", "source_sentence"), "ord").alias("_last")
    )
    edges = last.select(
        *EDGE_KEY,
        F.coalesce(F.nullif(F.col("_last.confidence"), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.col("_last.source_sentence").alias("source_sentence"),
    )
    return with_both_ends(edges, entities)


def without_cases(table: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """Rows none of whose case columns is in ``gone`` (case_id)."""
    for column in columns:
        table = table.join(gone.select(F.col("case_id").alias(column)), column, "left_anti")
    return table


def clear_cases(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Drop entities, touching edges and audit rows of the given cases; the cases stay."""
    return {
        "entities": without_cases(tables["entities"], gone, ["case_id"]),
        "edges": without_cases(tables["edges"], gone, ["src_case", "dst_case"]),
        "audit": without_cases(tables["audit"], gone, ["case_id"]),
    }


def delete_cases(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """As clear_cases, and the case rows go too."""
    return {**clear_cases(tables, gone), "cases": without_cases(tables["cases"], gone, ["case_id"])}


def ingest_stats(entities: DataFrame, edges: DataFrame, calls: DataFrame, transfers: DataFrame) -> DataFrame:
    """One row per case: entities per label, relationships, calls, transfers."""
    labels = LABELS + ["BankAccount"]
    tall = (
        entities.select("case_id", F.col("label").alias("kind"))
        .unionByName(edges.select(F.col("src_case").alias("case_id"), F.lit("relationships").alias("kind")))
        .unionByName(calls.select("case_id", F.lit("calls").alias("kind")))
        .unionByName(transfers.select("case_id", F.lit("transfers").alias("kind")))
    )
    wide = tall.groupBy("case_id").pivot("kind", labels + ["relationships", "calls", "transfers"]).count().na.fill(0)
    total = sum([F.col(label) for label in labels[1:]], F.col(labels[0]))
    return wide.withColumn("entities", total)
