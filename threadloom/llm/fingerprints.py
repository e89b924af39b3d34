"""Document fingerprints from spot signatures, in DataFrame functions alone.

Common words are anchors. After every run of anchors, the next ``CHAIN`` content words form a signature, and a
document is its set of signatures. A stretch without anchors takes a chain from each of its words. Sets are compared by Jaccard similarity; a pair whose sizes already exclude the wanted similarity
is pruned before any comparison, and the join below pairs only length partitions that can match.

Defined results: null is the empty text; the empty text has no signatures and is alike only to other empty sets; a
text whose anchors are followed by nothing, or that has no words, has its own hash as one signature; rows
without a doc_id come first in order, equal ids follow each other by their text; the only row is its own next one;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import common
from threadloom.operators.cutting import Workspace

#: Content words of a signature.
CHAIN = 3
#: In a run of more content words than this, every word starts a chain.
LONG = 12
#: Rows of a range of documents that is put in order by one task.
RANGE_ROWS = 2_000

# Common words of English, German, French and Spanish that anchor signatures.
ANCHORS = """a an the of to and in is it for on as with was be by that this are at from or not have has had he she his her they we you which
 der die das den dem des ein eine einen und ist im zu von mit auf für sich nicht auch als
 le la les un une du de et est en que qui dans pour par sur au aux avec ce ne pas
 el los las del al y o es con se su una como más pero""".split()

_ANCHOR = "(?: (?:" + "|".join(sorted(set(ANCHORS))) + ")(?= ))++ "


def _chain(parts: Column, at: Column) -> Column:
    """CHAIN neighbours from a place in an array, joined."""
    return F.concat_ws(" ", *[F.get(parts, at + i) for i in range(CHAIN)])


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``, the sorted distinct signature hashes of a text column."""
    runs, long, hashed = (common.free_name(df, f"{x}_") for x in ("runs", "long", "hashed"))
    own = F.coalesce(F.col(text), F.lit(""))
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(own), r"[^\p{L}\p{N}]++", " ")), F.lit(" "))
    out = df.withColumn(runs, F.transform(F.split(plain, _ANCHOR, -1), lambda run: F.trim(run)))
    spaces = lambda run: F.length(run) - F.length(F.replace(run, F.lit(" ")))
    out = out.withColumn(long, F.transform(F.filter(runs, lambda run: spaces(run) >= LONG), lambda run: F.split(run, " ", -1)))
    anchored = F.when(F.size(runs) > 1, F.transform(
        F.sequence(F.lit(1), F.size(runs) - 1),
        lambda i: F.substring_index(F.trim(_chain(F.col(runs), i)), " ", CHAIN)))
    sliding = F.flatten(F.transform(long, lambda words: F.transform(
        F.sequence(F.lit(0), F.size(words) - CHAIN), lambda j: _chain(words, j))))
    chains = F.filter(F.concat(F.coalesce(anchored, F.array().cast("array<string>")), sliding), lambda chain: chain != "")
    out = out.withColumn(hashed, F.array_sort(F.array_distinct(F.transform(chains, lambda chain: F.xxhash64(chain)))))
    empty = F.array().cast("array<bigint>")
    out = out.withColumn(name, F.when(own == "", empty).when(F.size(hashed) == 0, F.array(F.xxhash64(own))).otherwise(F.col(hashed)))
    return out.drop(runs, long, hashed)


def fingerprint(signatures: str) -> Column:
    """Size and digest of a signature set: equal exactly for equal sets."""
    return F.concat_ws("-", F.size(signatures).cast("string"), F.md5(F.col(signatures).cast("string").cast("binary")))


def likeness(left: str, right: str, floor: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 where their sizes alone exclude ``floor``."""
    small, large = F.least(F.size(left), F.size(right)), F.greatest(F.size(left), F.size(right))
    both = F.size(F.array_intersect(left, right))
    exact = both / (F.size(left) + F.size(right) - both)
    return F.when(large == 0, 1.0).when((small == 0) | (small < large * floor), 0.0).otherwise(exact)


# ---------------------------------------------------------------- next document


def dealt_with_heads(docs: DataFrame, work: Workspace, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Rows of (doc_id, text) with ``range`` and ``head``: every row in its range of ids, and once more the first row of
    each range, as the head that follows the range before; the first range's head follows the last range."""
    ranged = docs.withColumn("range", common.doc_ranges(docs, rows_per_range))
    every = Window.orderBy("range")
    last = F.max("range").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ids = ranged.groupBy("range").agg(F.min("doc_id").alias("first_id"))
    firsts = work.cut(ids.select(
        F.coalesce(F.lag("range").over(every), last).alias("before"), F.col("range").alias("head_range"), "first_id"), "firsts")
    heads = ranged.join(firsts, (F.col("range") == F.col("head_range")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    heads = heads.withColumn("place", F.row_number().over(Window.partitionBy("head_range").orderBy("text"))).filter("place = 1")
    return ranged.withColumn("head", F.lit(False)).unionByName(
        heads.select("doc_id", "text", F.col("before").alias("range"), F.lit(True).alias("head")))


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, spots, next_text, next_spots and the edited text with its spots.

    The edited text ends in the beginning of the next document: a quarter of its own length, or all of it.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_signatures(dealt_with_heads(own, Workspace(docs.sparkSession, "fingerprints")), "text", "spots")
    inside = Window.partitionBy("range").orderBy("head", F.col("doc_id").asc_nulls_first(), "text")
    pairs = rows.withColumns({f"next_{c}": F.lead(c).over(inside) for c in ("text", "spots")}).filter("NOT head").drop("range", "head")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    changed = pairs.withColumn(
        "edited", F.concat(F.col("text").substr(F.lit(1), n - quarter), F.col("next_text").substr(F.lit(1), quarter)))
    return with_signatures(changed, "edited", "edited_spots")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited form, and how alike they and the next document are."""
    return edited(docs).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("spots").alias("fingerprint"), fingerprint("edited_spots").alias("edited_fingerprint"),
        likeness("spots", "edited_spots").alias("near_edited"), likeness("spots", "next_spots").alias("near_next"),
    )


# ---------------------------------------------------------------- similarity join


def near_pairs(docs: DataFrame, floor: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of class representatives at or above ``floor``; ``classes`` maps documents to them.

    Only signatures in the rare prefix of a set are indexed: two sets at the floor share one of them. They are dealt by
    signature and by set length: lengths of one partition differ by a factor of 1 / ``floor`` at most, so a set meets
    those of its own partition and, as a visitor, of the next one; all others are never joined.
    """
    width = max(-math.log(floor), 1e-9) * (1 + 1e-9) if floor > 0 else math.inf
    work = Workspace(docs.sparkSession, "spots")
    reps = work.cut(classes(docs).filter("doc_id = class_id").select("class_id", "spots").dropDuplicates(["class_id"]), "classes")
    spots = reps.select("class_id", F.size("spots").alias("size"), F.explode("spots").alias("spot"))
    rarity = spots.groupBy("spot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranked = spots.join(rarity, "spot").withColumn(
        "place", F.row_number().over(Window.partitionBy("class_id").orderBy("n", "spot")))
    alone = F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("class_id"))
    prefix = work.cut(
        ranked.withColumn("place", F.col("place") + alone).filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * floor) + 1)
        .select("class_id", "size", "spot"), "prefixes")
    homes = prefix.withColumns({"part": F.floor(F.log("size") / width), "visits": F.lit(False)})
    both = homes.unionByName(homes.withColumns({"part": F.col("part") + 1, "visits": F.lit(True)}))
    fits = (F.col("l.spot") == F.col("r.spot")) & (F.col("l.part") == F.col("r.part")) & (
        F.col("r.visits") | (F.col("l.class_id") < F.col("r.class_id"))) & (
        F.least("l.size", "r.size") >= F.greatest("l.size", "r.size") * floor)
    pairs = homes.alias("l").join(both.alias("r"), fits).select(
        F.least("l.class_id", "r.class_id").alias("a"), F.greatest("l.class_id", "r.class_id").alias("b")).distinct()
    side = lambda name: reps.select(F.col("class_id").alias(name), F.col("spots").alias(f"spots_{name}"))
    scored = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", likeness("spots_a", "spots_b", floor).alias("likeness"))
    return scored.filter(F.col("likeness") >= floor)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id with the same signature set), spots; rows without an id or signatures are left out."""
    own = with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "spots").select(
        "doc_id", "spots", fingerprint("spots").alias("fingerprint")).filter("doc_id is not null and size(spots) > 0")
    smallest = own.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"))
    return own.join(smallest, "fingerprint").select("doc_id", "class_id", "spots")
