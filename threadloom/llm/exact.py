"""Exact deduplication by two-pass Bloom filtering, in DataFrame functions alone.

Pass one sets, for every text digest, two bits of a blocked Bloom filter (both in one segment) and keeps the bits that
at least two rows set. Pass two tests every row against these: a row with a bit that no other row set is alone and
passes straight through; the others shuffle by digest, where equal digests are counted and the false alarms drop out.
The filter has ``SLOTS`` bits a row, and no more than ``MOST_SEGMENTS`` segments (64 MB): it is the only broadcast but
for the digests of groups above a thousandth of all rows, of which there are fewer than a thousand. On tables too large
for that filter more rows shuffle (as digests of 32 bytes, never as texts); the result is the same.

Defined results: a null text counts as empty; of equal texts the row with the largest doc_id stays, exactly one where
rows repeat it; a row without an id stays only if no equal row has one, and its keep_id is null; an empty table gives no
rows; ``deduplicate`` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import common
from threadloom.operators.cutting import Workspace

#: Bits of the filter for each row.
SLOTS = 16
#: Bits of a segment, which is one bitmap of Spark's bitmap functions.
SEGMENT = 1 << 15
#: Segments of 4 kB that the filter may have.
MOST_SEGMENTS = 1 << 14
#: A group of more than this share of all rows is looked up by broadcast.
HEAVY = 1000


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _segment(key: str, segments: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(segments)).cast("int")


def _places(key: str) -> list[Column]:
    """The two bits of a digest in its segment."""
    drawn = F.xxhash64(F.lit("bits"), F.col(key))
    return [drawn.bitwiseAND(SEGMENT - 1), F.shiftrightunsigned(drawn, 32).bitwiseAND(SEGMENT - 1)]


def repeated_filter(digests: DataFrame, key: str, rows: int) -> tuple[DataFrame, int]:
    """(segment, bits) with the bits that at least two rows of ``digests`` set, and the number of segments."""
    segments = min(max(1, -(-rows * SLOTS // SEGMENT)), MOST_SEGMENTS)
    bits = digests.select(_segment(key, segments).alias("segment"), F.explode(F.array_distinct(F.array(*_places(key)))).alias("place"))
    often = bits.groupBy("segment", "place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # one row a bit: dealt by segment without skew, so that whole bitmaps are built where they stay
    return often.repartition("segment").groupBy("segment").agg(F.bitmap_construct_agg("place").alias("bits")), segments


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(7).cast("int")) == 1


def maybe_repeated(rows: DataFrame, key: str, bitmaps: DataFrame, segments: int, name: str) -> DataFrame:
    """``rows`` with a boolean: false only where no other row has the digest."""
    taken = [common.free_name(rows, c) for c in ("filter_segment", "filter_bits")]
    held = rows.join(F.broadcast(bitmaps.toDF(*taken)), _segment(key, segments) == F.col(taken[0]), "left")
    bits = F.col(taken[1])
    both = [_is_set(bits, place) for place in _places(key)]
    return held.withColumn(name, bits.isNotNull() & both[0] & both[1]).drop(*taken)


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    work = Workspace(docs.sparkSession, "exact")
    rows = work.cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest("text").alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    total = rows.count()
    bitmaps, segments = repeated_filter(rows, "digest", total)
    bitmaps = work.cut(bitmaps, "filter")
    tested = maybe_repeated(rows, "digest", bitmaps, segments, "again")
    again = work.cut(tested.filter("again").drop("again"), "candidates")
    last = F.max(F.struct("doc_id", "row"))
    groups = work.cut(again.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), last.alias("last")).filter("size > 1").withColumn(
        "heavy", F.col("size") * HEAVY > total), "groups")
    heavy = F.broadcast(groups.filter("heavy").select("digest", "size", "last"))
    in_heavy = again.join(heavy, "digest")
    others = again.join(heavy.select("digest"), "digest", "left_anti").join(groups.filter("not heavy").drop("heavy"), "digest", "left")
    alone = tested.filter("not again").select("digest", "doc_id", "row", F.lit(None).cast("long").alias("size"), F.lit(None).cast(
        "struct<doc_id: bigint, row: bigint>").alias("last"))
    every = alone.unionByName(in_heavy).unionByName(others)
    return every.select(
        "doc_id", F.when(F.col("last").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("last.row"), F.lit(True)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents with one row of each distinct text, all columns kept; only texts that may repeat are shuffled."""
    key, mark, order = (common.free_name(docs, c) for c in ("text_digest", "may_repeat", "row_order"))
    rows = docs.withColumn(key, digest("text"))
    bitmaps, segments = repeated_filter(rows, key, docs.count())
    bitmaps = Workspace(docs.sparkSession, "exact").cut(bitmaps, "filter")
    tested = maybe_repeated(rows, key, bitmaps, segments, mark).withColumn(order, F.monotonically_increasing_id())
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct("doc_id", order)).alias("best")
    return tested.filter(~F.col(mark)).select(docs.columns).unionByName(tested.filter(mark).groupBy(key).agg(best).select("best.*"))
