"""Personal data by patterns and bootstrapped contextual extraction, in DataFrame functions alone.

Base patterns give seed entities. A lexical pattern is the word before an entity and the shape of its whole span.
Instances are all base spans, all tokens with a digit or an at sign, and all groups of digits with separators that have
the shape of enough seeds; patterns and instances form a weighted graph over all documents. Scores run over it in rounds: a pattern is as trustworthy as
the share of its instances that are, an instance as its patterns. Trusted patterns of enough different seeds then
discover identifiers that no base pattern knows; these spans are added, base spans stay.

Matches are located by splitting a text at the same regular expression that extracts them. The expressions find what
the base definitions find, but never go back inside a run of characters, so long runs cost linear time.

Defined results: null is the empty text; a document without spans has empty digests of nothing; rows that repeat have
the same spans; rows without a doc_id are searched like any other; an empty table gives no rows; extra columns are
ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import common
from threadloom.operators.cutting import Workspace

KINDS = ["email", "ip", "card", "phone"]
# Base patterns; a possessive run, or a look behind for its start, stands where going back could not help.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token with a digit or an at sign: what an identifier without separators may look like.
TOKEN = r"(?<![\p{L}\p{N}_@+=/.%-])[\p{L}_+=/.%-]*+[0-9@][\p{L}\p{N}_@+=/.%-]*+"
#: Where digits in groups may begin: ten digits or more follow, as cards and phones have; the rest is the second group.
GROUPS = r"(\+|(?<![0-9])[0-9])(?=(?:[\x20().-]*+[0-9]){9})(?=([\x20().0-9-]{0,%d}))"

ROUNDS = 3
#: A pattern counts with so many different seeds, and is trusted from this score on.
SEEDS, TRUST = 3, 0.8
#: Score from which an instance of a trusted pattern is taken, and its least length.
ACCEPT, LEAST_LENGTH = 0.5, 6

SPAN = "struct<start:int,stop:int,value:string,left:string>"


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _places(start: Column, stop: Column) -> Column:
    """The numbers from ``start`` up to ``stop``; a slice of an array would copy all of it."""
    return F.when(start < stop, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<int>"))


def running(items: Column, measure, combine, zero) -> Column:
    """For every item what ``combine`` makes of the measures of those before it, an array of numbers.

    Arrays can only grow by copying, so items go in runs of about the square root of their number.
    """
    def whole(p: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(p))), F.lit(32)).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / width).cast("int")), lambda c: F.slice(p, c * width + 1, width))
        return F.when(F.size(p) > 0, _let(runs, over)).otherwise(F.array().cast("array<int>"))

    def prefix(start: Column, values: Column) -> Column:
        state = "struct<now:int,out:array<int>>"
        first = F.struct(start.cast("int").alias("now"), F.array().cast("array<int>").alias("out")).cast(state)
        return F.aggregate(values, first, lambda s, v: F.struct(
            combine(s["now"], v).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")).cast(state), lambda s: s["out"])

    def over(runs: Column) -> Column:
        measured = F.transform(runs, lambda run: F.transform(run, lambda x: measure(x).cast("int")))
        return _let(measured, within)

    def within(measured: Column) -> Column:
        totals = F.transform(measured, lambda run: F.aggregate(run, F.lit(zero).cast("int"), lambda a, b: combine(a, b)))
        begun = F.arrays_zip(measured.alias("run"), prefix(F.lit(zero), totals).alias("start"))
        return F.flatten(F.transform(begun, lambda x: prefix(x["start"], x["run"])))

    return _let(items, whole)


def located(text: str, pattern: str) -> Column:
    """Array of (start, stop, value, left): matches in order, with up to 60 characters before each."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(text), pattern, -1)
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), values.alias("value")), lambda x: x["value"].isNotNull())

    def before(p: Column, gap: Column, i: Column) -> Column:
        """The text before a match: its gap, and as many matches before that as 60 characters may hold."""
        some = F.transform(_places(F.greatest(i - 60, F.lit(0)), i), lambda j: F.concat(F.get(p, j)["gap"], F.get(p, j)["value"]))
        return F.substring(F.when(F.length(gap) >= 60, gap).otherwise(F.concat(F.array_join(some, ""), gap)), -60, 60)

    def spans_of(p: Column) -> Column:
        ends = running(p, lambda x: F.length(x["gap"]) + F.length(x["value"]), lambda a, b: a + b, 0)
        placed = F.arrays_zip(p.alias("own"), ends.alias("at"))

        def span(x: Column, i: Column) -> Column:
            gap, value = x["own"]["gap"], x["own"]["value"]
            start = x["at"] + F.length(gap)
            return F.struct(start.alias("start"), (start + F.length(value)).alias("stop"), value.alias("value"), before(p, gap, i).alias("left"))

        return F.transform(placed, span)

    return _let(pairs, spans_of).cast(f"array<{SPAN}>")


def _word(left: Column) -> Column:
    """The word before a span, lower-cased, its digits alike."""
    return F.regexp_replace(F.lower(F.regexp_extract(left, r"(\S+)\s*+$", 1)), "[0-9]", "9")


def _shape(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), r"\p{Ll}++", "a"), r"\p{Lu}++", "A")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small(value: Column) -> Column:
    """Every part of a dotted number is at most 255."""
    def fits(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

    return F.forall(F.split(value, "\\."), fits)


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def weight(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + weight(i))
    return total % 10 == 0


def base_spans(text: str) -> Column:
    """Array of (start, rank, stop, kind, value, left), by start and then kind as listed."""
    checks = [
        (EMAIL, F.contains(F.col(text), F.lit("@")), None),
        (IP, F.contains(F.col(text), F.lit(".")), _small),
        (CARD, F.lit(True), _luhn),
        (PHONE, F.contains(F.col(text), F.lit("+")), lambda v: F.length(_digits(v)).between(10, 15)),
    ]
    def part(rank: int, pattern: str, likely: Column, good) -> Column:
        found = F.when(likely, located(text, pattern)).otherwise(F.array().cast(f"array<{SPAN}>"))
        if good:
            found = F.filter(found, lambda x: good(x["value"]))
        return F.transform(found, lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), F.lit(KINDS[rank]).alias("kind"),
            x["value"].alias("value"), _word(x["left"]).alias("left")))

    parts = [part(rank, *check) for rank, check in enumerate(checks)]
    return F.array_sort(F.concat(*parts))


def _tokens(text: str) -> Column:
    """Array of (start, stop, value, left) of tokens with a digit or an at sign, trailing punctuation cut off."""
    def trimmed(x: Column) -> Column:
        value = F.regexp_replace(x["value"], "[=/.%-]++$", "")
        return F.struct(
            x["start"].alias("start"), (x["start"] + F.length(value)).alias("stop"), value.alias("value"), _word(x["left"]).alias("left"))

    return F.transform(located(text, TOKEN), trimmed)


def scan(docs: DataFrame, work: Workspace) -> DataFrame:
    """Written once: doc_id, text_key, base spans and tokens of every text; the text itself is left behind."""
    own = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    likely = F.rlike("text", F.lit("[0-9@]"))
    none = F.array()
    found = own.withColumn("base", base_spans("text")).withColumn("tokens", _tokens("text"))
    return work.cut(found.select(
        "doc_id", F.xxhash64("text").alias("text_key"), "base",
        F.when(likely, F.col("tokens")).otherwise(none.cast(dict(found.dtypes)["tokens"])).alias("tokens")), "scan")


def _instances(found: DataFrame, spans_: str, kind: Column) -> DataFrame:
    """One row per span of an array with a word before it: its value, pattern and kind."""
    rows = found.filter(F.size(spans_) > 0).select("doc_id", "text_key", F.explode(spans_).alias("t")).filter("t.left <> ''")
    shape = _shape(F.col("t.value"))
    return rows.select(
        "doc_id", "text_key", "t.start", "t.stop", "t.value", shape.alias("shape"), F.concat_ws(" ", "t.left", shape).alias("pattern"), kind.alias("kind"))


def _apart(spans_: str) -> Column:
    """The spans of an array that meet no base span, found in one sweep over both by start."""
    far = (1 << 31) - 1

    def marked(x: Column, own: bool) -> Column:
        text = lambda name: x[name] if own else F.lit("")
        return F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["stop"].alias("stop"), text("value").alias("value"), text("left").alias("left"))

    both = F.array_sort(F.concat(F.transform("base", lambda x: marked(x, False)), F.transform(spans_, lambda x: marked(x, True))))

    def swept(p: Column) -> Column:
        reached = running(p, lambda x: F.when(x["own"], 0).otherwise(x["stop"]), F.greatest, 0)
        begun = F.reverse(running(F.reverse(p), lambda x: F.when(x["own"], far).otherwise(x["start"]), F.least, far))
        free = F.filter(F.arrays_zip(p.alias("x"), reached.alias("reached"), begun.alias("begun")), lambda z: (
            z["x"]["own"] & (z["reached"] <= z["x"]["start"]) & (z["begun"] >= z["x"]["stop"])))
        return F.transform(free, lambda z: F.struct(
            z["x"]["start"].alias("start"), z["x"]["stop"].alias("stop"), z["x"]["value"].alias("value"), z["x"]["left"].alias("left")))

    return F.when(F.size("base") == 0, F.col(spans_)).otherwise(_let(both, swept).cast(f"array<{SPAN}>"))


def occurrences(found: DataFrame) -> DataFrame:
    """Base spans, which are the seeds, and tokens apart from them."""
    tokens = found.select("doc_id", "text_key", _apart("tokens").alias("tokens"))
    return _instances(found, "base", F.col("t.kind")).unionByName(_instances(tokens, "tokens", F.lit(None).cast("string")))


def grouped(docs: DataFrame, seeds: DataFrame, found: DataFrame, work: Workspace) -> DataFrame | None:
    """Digits in groups, apart from base spans, in every shape that enough seeds after one word have; overlaps stay."""
    own = seeds.filter("kind is not null").filter(F.rlike("shape", F.lit(r"[\x20()]")))
    shapes = own.groupBy("pattern", "shape").agg(F.countDistinct("value").alias("n")).filter(F.col("n") >= SEEDS).select("shape").distinct()
    listed = sorted(r["shape"] for r in shapes.collect())
    if not listed:
        return None
    pattern = GROUPS % max(map(len, listed))
    known = F.array(*[F.lit(x) for x in listed])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.rlike("text", F.lit(pattern)))
    tails = F.regexp_extract_all("text", F.lit(pattern), F.lit(2))

    def windows(x: Column) -> Column:
        run = F.concat(x["at"]["value"], x["tail"])
        form = F.regexp_replace(run, "[0-9]", "9")
        fits = F.filter(known, lambda s: F.startswith(form, s) & (F.substring(form, F.length(s) + 1, F.lit(1)) != "9"))
        return F.transform(fits, lambda s: F.struct(
            x["at"]["start"].alias("start"), (x["at"]["start"] + F.length(s)).alias("stop"), F.substring(run, F.lit(1), F.length(s)).alias("value"),
            _word(x["at"]["left"]).alias("left")))

    groups = rows.select(
        "doc_id", F.xxhash64("text").alias("text_key"),
        F.flatten(F.transform(F.arrays_zip(located("text", pattern).alias("at"), tails.alias("tail")), windows)).alias("groups"))
    groups = work.cut(groups.filter(F.size("groups") > 0), "grouped")
    bases = found.filter(F.size("base") > 0).select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), "base").dropDuplicates(
        ["own_id", "own_key"])
    held = groups.join(bases, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")), "left")
    held = held.withColumn("base", F.coalesce("base", F.array().cast(dict(found.dtypes)["base"])))
    return _instances(held.select("doc_id", "text_key", _apart("groups").alias("groups")), "groups", F.lit(None).cast("string"))


def trusted(tokens: DataFrame, work: Workspace) -> DataFrame:
    """(pattern, value, kind): instances that trusted patterns discover."""
    edges = work.cut(tokens.groupBy("pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")), "graph")
    scores = edges.groupBy("value").agg(F.when(F.max("kind").isNotNull(), 1.0).otherwise(0.0).alias("score"), F.max("kind").alias("seed"))
    scores = work.cut(scores, "scores")
    seeds = edges.filter("kind is not null").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    kinds = seeds.groupBy("pattern").agg(F.max_by("kind", F.struct("seeds", "kind")).alias("pattern_kind"), F.sum("seeds").alias("seeds"))
    kinds = work.cut(kinds.filter(F.col("seeds") >= SEEDS), "pattern-kinds")
    graph = work.cut(edges.drop("kind").join(kinds, "pattern"), "seeded-graph")
    for _ in range(ROUNDS):
        patterns = graph.join(scores, "value").groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("trust"))
        reached = graph.join(patterns, "pattern").groupBy("value").agg((F.sum(F.col("trust") * F.col("n")) / F.sum("n")).alias("reach"))
        scores = work.cut(scores.join(reached, "value", "left").select(
            "value", F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.coalesce("reach", F.lit(0.0))).alias("score"), "seed"), "scores")
    good = graph.join(scores, "value").groupBy("pattern", "pattern_kind").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("trust")).filter(F.col("trust") >= TRUST)
    new = graph.select("pattern", "value").join(good, "pattern").join(scores, "value")
    return new.filter((F.col("score") >= ACCEPT) & (F.length("value") >= LEAST_LENGTH)).select("pattern", "value", F.col("pattern_kind").alias("kind"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base and all spans: arrays of (start, rank, stop, kind), by start and then kind."""
    work = Workspace(docs.sparkSession, "pii")
    found = scan(docs, work)
    tokens = work.cut(occurrences(found), "tokens")
    groups = grouped(docs, tokens, found, work)
    if groups is not None:
        tokens = tokens.unionByName(work.cut(groups, "groups"))
    added = tokens.filter("kind is null").drop("kind").join(trusted(tokens, work), ["pattern", "value"])
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    more = added.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.struct("start", rank.alias("rank"), "stop", "kind"))).alias("more"))
    more = more.withColumnsRenamed({"doc_id": "more_id", "text_key": "more_key"})
    slim = found.select("doc_id", "text_key", F.transform("base", lambda x: x.dropFields("value", "left")).alias("base"))
    joined = slim.join(more, F.col("doc_id").eqNullSafe(F.col("more_id")) & (F.col("text_key") == F.col("more_key")), "left")
    return joined.select("doc_id", "text_key", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(
        F.array_sort(F.concat("base", "more"))).alias("all"))


def _listed(spans_: str) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Counts and digest of base spans, and all spans, per document."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return spans(docs).select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("all").alias("spans"))


#: Characters of the pieces that a text is cut into, in two steps, so that no place is far from where a piece begins.
COARSE, FINE = 1 << 18, 1 << 12


def _pieces(text: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / width).cast("int")), lambda i: F.substring(text, i * width + 1, F.lit(width)))


def masked(text: str, spans_: str) -> Column:
    """The text with every span (or run of overlapping spans) replaced by its kind in angle brackets."""
    fine = F.flatten(F.transform(_pieces(F.col(text), COARSE), lambda part: F.slice(_pieces(part, FINE), 1, COARSE // FINE)))

    def between(pieces: Column, start: Column, stop: Column) -> Column:
        first = F.shiftright(start, 12)
        joined = F.array_join(F.transform(_places(first, F.shiftright(stop, 12) + 1), lambda j: F.get(pieces, j)), "")
        return F.substring(joined, start.bitwiseAND(FINE - 1) + 1, stop - start)

    def joined(pieces: Column) -> Column:
        reached = running(F.col(spans_), lambda x: x["stop"], F.greatest, 0)
        kept = F.filter(F.arrays_zip(F.col(spans_).alias("x"), reached.alias("at")), lambda z: z["x"]["start"] >= z["at"])
        parts = F.transform(kept, lambda z: F.concat(between(pieces, z["at"], z["x"]["start"]), F.lit("<"), F.upper(z["x"]["kind"]), F.lit(">")))
        end = F.array_max(F.transform(spans_, lambda x: x["stop"]))
        return F.concat(F.array_join(parts, ""), between(pieces, end, F.length(F.col(text))))

    return F.when(F.size(spans_) > 0, _let(fine, joined)).otherwise(F.col(text))


def mask(docs: DataFrame) -> DataFrame:
    """All documents with their spans masked in text; an n_chars column follows the new text, others are kept."""
    key, found_id, found_key, found_spans = (common.free_name(docs, x) for x in ("pii_key", "pii_id", "pii_text", "pii_spans"))
    found = spans(docs).filter(F.size("all") > 0).select(
        F.col("doc_id").alias(found_id), F.col("text_key").alias(found_key), F.col("all").alias(found_spans)).dropDuplicates([found_id, found_key])
    own = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = own.join(found, F.col("doc_id").eqNullSafe(F.col(found_id)) & (F.col(key) == F.col(found_key)), "left")
    rows = rows.withColumn("text", F.when(F.col(found_spans).isNull(), F.col("text")).otherwise(masked("text", found_spans)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(found_spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*docs.columns)
