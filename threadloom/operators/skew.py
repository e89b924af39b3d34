"""Helpers that keep a hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_row_number(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """Row number per key (from 0) where ``bucket`` rises with ``order``.

    Rows are numbered inside (key, bucket); bucket sizes are then prefix-summed per key, so a
    key that holds a third of the table is numbered by as many tasks as it has buckets.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_inner", F.row_number().over(inside) - 1)
        .join(starts, [*keys, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_inner")).cast("long"))
        .drop("_bucket", "_inner", "_start")
    )


def bucketed_lag(df: DataFrame, key: str, order: str, value: str, name: str, width: int = 100_000) -> DataFrame:
    """Previous ``value`` per key by a whole-number ``order``; gaps in the order are allowed."""
    rows = df.withColumn("_bucket", F.floor(F.col(order) / width))
    last = rows.groupBy(key, "_bucket").agg(F.max_by(value, order).alias("_last"))
    carried = last.select(
        key, "_bucket", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket")).alias("_carried")
    )
    inside = Window.partitionBy(key, "_bucket").orderBy(order)
    return (
        rows.withColumn("_rank", F.row_number().over(inside))
        .withColumn("_lag", F.lag(value).over(inside))
        .join(carried, [key, "_bucket"])
        .withColumn(name, F.when(F.col("_rank") == 1, F.col("_carried")).otherwise(F.col("_lag")))
        .drop("_bucket", "_rank", "_lag", "_carried")
    )


def salted_running_sum(df: DataFrame, keys: list[str], member: str, value: str, name: str,
                       chunk: int = 100_000) -> DataFrame:
    """Exclusive running sum per key in any fixed member order; big keys are split into chunks."""
    counts = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_salts"))
    rows = df.join(counts, keys).withColumn("_salt", F.pmod(F.xxhash64(member), F.col("_salts")))
    totals = rows.groupBy(*keys, "_salt").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_salt", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = (
        Window.partitionBy(*keys, "_salt").orderBy(member).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, [*keys, "_salt"])
        .withColumn(name, F.col("_start") + F.col("_inner"))
        .drop("_salts", "_salt", "_inner", "_start")
    )


def tiled_pairs(df: DataFrame, keys: list[str], member: str, chunk: int = 2_000) -> DataFrame:
    """Ordered member pairs (``member_a`` < ``member_b``) that share ``keys``.

    The left side of a big group is split into chunks and the right side repeated once per
    chunk, so each task joins at most ``chunk`` left rows of any group.
    """
    rows = df.select(*keys, member).distinct()
    tiles = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        *keys, F.ceil(F.col("_n") / chunk).cast("int").alias("_tiles")
    )
    tiled = rows.join(tiles, keys)
    left = tiled.select(
        *keys, F.col(member).alias(f"{member}_a"), F.pmod(F.xxhash64(member), F.col("_tiles")).alias("_tile")
    )
    right = tiled.select(
        *keys,
        F.col(member).alias(f"{member}_b"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles").cast("long") - 1)).alias("_tile"),
    )
    return (
        left.join(right, [*keys, "_tile"])
        .filter(F.col(f"{member}_a") < F.col(f"{member}_b"))
        .drop("_tile")
    )
