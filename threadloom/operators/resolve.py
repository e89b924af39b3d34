"""Entity resolution: blocked name matching within and across cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import rules
from threadloom.functions.scoring import name_tokens, sequence_ratio, token_score
from threadloom.functions.text import normalise_text, strip
from threadloom.operators.cutting import Workspace
from threadloom.operators.skew import tiled_pairs

# ---------------------------------------------------------------- blocking


def _min_common(size: Column, threshold: float) -> Column:
    """Fewest shared tokens that let two unequal names of this larger size reach the threshold.

    The character ratio of unequal names is below 100, so the token part alone must exceed
    (threshold - 40) / 60.
    """
    return (F.floor(size * ((threshold - 40.0) / 60.0)) + 1).cast("int")


def _blocked(lows: DataFrame, threshold: float) -> DataFrame:
    """Names with one row per block key; similar names share a key.

    Every name is keyed by its whole token set. A name that may match one with another token
    set is also keyed by its rarest tokens, as many as it can miss plus one.
    """
    named = lows.select("low").distinct().withColumn("tokens", name_tokens(F.col("low")))
    named = named.filter(F.size("tokens") > 0)
    size = F.size("tokens")
    whole = named.select("low", "tokens", F.concat(F.lit("="), F.array_join(F.array_sort("tokens"), "\u0001")).alias("key"))
    partial = (_min_common(size, threshold) <= size - 1) | (_min_common(size + 1, threshold) <= size)
    loose = named.filter(partial)
    spread = loose.select("low", F.explode("tokens").alias("token"))
    counts = spread.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = spread.join(counts, "token").groupBy("low").agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("ranked")
    )
    prefix = ranked.withColumn("tokens", name_tokens(F.col("low"))).select(
        "low", "tokens",
        F.explode(F.slice("ranked", F.lit(1), size - _min_common(size, threshold) + 1)).alias("r"),
    ).select("low", "tokens", F.concat(F.lit("~"), F.col("r.token")).alias("key"))
    return whole.unionByName(prefix)


def similar_names(lows: DataFrame, threshold: float) -> DataFrame:
    """Ordered pairs of different lower-case names scoring at least ``threshold``.

    Returns (low_a, low_b, score) in both orders, since the score depends on the order. Names
    are compared once each, however many rows or cases carry them.
    """
    if not 40.0 < threshold <= 100.0:
        raise ValueError("the threshold must lie above 40 and not above 100")
    keyed = _blocked(lows, threshold)
    a = keyed.select("key", F.col("low").alias("low_a"), F.col("tokens").alias("tok_a"))
    b = keyed.select("key", F.col("low").alias("low_b"), F.col("tokens").alias("tok_b"))
    larger = F.greatest(F.size("tok_a"), F.size("tok_b"))
    needed = _min_common(larger, threshold)
    pairs = (
        a.join(b, "key")
        .filter((F.col("low_a") != F.col("low_b")) & (F.least(F.size("tok_a"), F.size("tok_b")) >= needed))
        .withColumn("overlap", token_score(F.col("tok_a"), F.col("tok_b")))
        .filter(F.size(F.array_intersect("tok_a", "tok_b")) >= needed)
        .select("low_a", "low_b", "overlap")
        .distinct()
    )
    scored = pairs.select(
        "low_a", "low_b", (sequence_ratio("low_a", "low_b") * 0.4 + F.col("overlap") * 0.6).alias("score")
    )
    return scored.filter(F.col("score") >= threshold)


# ---------------------------------------------------------------- within a case


def _initial_parts(tokens: Column) -> tuple[Column, Column]:
    """Surname and leading initials of a token array."""
    surname = F.lower(F.try_element_at(tokens, F.lit(-1)))
    leading = F.transform(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t: F.lower(F.left(t, F.lit(1))))
    return surname, leading


def _plain_tokens(name: Column) -> Column:
    return F.filter(F.split(name, r"(?U)\s+"), lambda t: t != "")


def _dotted_tokens(name: Column) -> Column:
    return _plain_tokens(F.replace(name, F.lit("."), F.lit(" ")))


def with_mention_keys(names: DataFrame, strict_initials: bool = False) -> DataFrame:
    """Keys a mention is looked up by: surname with initials, and bare surname."""
    dotted, plain = _dotted_tokens(F.col("name")), _plain_tokens(F.col("name"))
    surname, leading = _initial_parts(F.col("_dotted"))
    usable = F.size("_dotted") >= 2
    if strict_initials:
        usable = usable & F.forall(
            F.slice("_dotted", F.lit(1), F.greatest(F.size("_dotted") - 1, F.lit(0))), lambda t: F.length(t) == 1
        )
    return (
        names.withColumn("_dotted", dotted).withColumn("_plain", plain)
        .withColumn("low", normalise_text(F.col("name")))
        .withColumn("ikey", F.when(usable, F.concat_ws("\u0001", surname, leading)))
        .withColumn("skey", F.when(F.size("_plain") == 1, F.lower(F.try_element_at("_plain", F.lit(1)))))
        .withColumn("ntok", F.size("_plain"))
        .drop("_dotted", "_plain")
    )


def _known_keys(known: DataFrame) -> DataFrame:
    """Surname-and-initials prefixes, and the bare surname, under which a known name is found."""
    parts = known.withColumn("_plain", _plain_tokens(F.col("known"))).filter(F.size("_plain") > 0)
    surname, leading = _initial_parts(F.col("_plain"))
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("_plain") - 1),
        lambda n: F.concat_ws("\u0001", surname, F.slice(leading, F.lit(1), n)),
    )
    long_enough = F.size("_plain") >= 2
    initials = parts.filter(long_enough).select("case_id", "known", F.explode(prefixes).alias("key"))
    return initials.withColumn("kind", F.lit("i")).unionByName(
        parts.select("case_id", "known", surname.alias("key"), F.lit("s").alias("kind"))
    )


def _key_counts(known: DataFrame) -> DataFrame:
    """How many known names each key leads to, and one of them."""
    return _known_keys(known).groupBy("case_id", "kind", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("known").alias("only")
    )


def match_initials(mentions: DataFrame, known: DataFrame, strict_initials: bool = False) -> DataFrame:
    """Mentions such as 'R. Sharma' with the single known name they fit."""
    counts = _key_counts(known).filter("kind = 'i' AND n = 1").select("case_id", F.col("key").alias("ikey"), "only")
    keyed = with_mention_keys(mentions, strict_initials)
    return keyed.join(counts, ["case_id", "ikey"]).select("case_id", "name", F.col("only").alias("known"))


def match_surname(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """One-word mentions with the single known name that ends in them."""
    counts = _key_counts(known).filter("kind = 's' AND n = 1").select("case_id", F.col("key").alias("skey"), "only")
    keyed = with_mention_keys(mentions)
    return keyed.join(counts, ["case_id", "skey"]).select("case_id", "name", F.col("only").alias("known"))


def _known_order(known: DataFrame) -> DataFrame:
    """Known names in list order: stored ones first, then longer names, then by name."""
    if "is_new" not in known.columns:
        known = known.withColumn("is_new", F.lit(False))
    return known.withColumn(
        "_ord", F.struct("is_new", (-F.size(_plain_tokens(F.col("known")))).alias("len"), F.col("known").alias("k"))
    ).withColumn("_klow", normalise_text(F.col("known")))


def best_fuzzy(mentions: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Best-scoring known name per mention; the earlier known name wins ties."""
    first = _known_order(known).groupBy("case_id", "_klow").agg(F.min("_ord").alias("_ord"))
    same = mentions.select("low").distinct().select(
        F.col("low").alias("low_a"), F.col("low").alias("low_b"), F.lit(100.0).alias("score")
    )
    scores = pairs.unionByName(same)
    hits = (
        mentions.select("case_id", "name", "low")
        .join(scores.withColumnRenamed("low_a", "low").withColumnRenamed("low_b", "_klow"), "low")
        .join(first, ["case_id", "_klow"])
    )
    best = hits.groupBy("case_id", "name").agg(
        F.min(F.struct((-F.col("score")).alias("s"), F.col("_ord").alias("o"))).alias("_best")
    )
    return best.select(
        "case_id", "name", F.col("_best.o.k").alias("fuzzy"), (-F.col("_best.s")).alias("fuzzy_score")
    )


def resolve(mentions: DataFrame, known: DataFrame, pairs: DataFrame | None = None,
            threshold: float = rules.WITHIN_CASE_THRESHOLD, strict_initials: bool = False) -> DataFrame:
    """Canonical name of each distinct (case_id, name) against (case_id, known).

    Exact, then best fuzzy, then unique initials, then unique surname, then the name itself.
    Returns (case_id, raw_name, canonical_name, score, resolution_type).
    """
    trimmed = mentions.select("case_id", strip(F.col("name")).alias("name")).distinct()
    asked = with_mention_keys(trimmed, strict_initials)
    if pairs is None:
        # distinct names are few next to their mentions: written once, read by every branch below
        work = Workspace(mentions.sparkSession, "resolve")
        asked = work.cut(asked, "asked")
        known = work.cut(known.distinct(), "known")
        lows = asked.select("low").union(known.select(normalise_text(F.col("known"))))
        pairs = similar_names(lows, threshold)
    exact = known.select("case_id", F.col("known").alias("name")).distinct().withColumn("_exact", F.lit(True))
    fuzzy = best_fuzzy(asked, known, pairs)
    counts = _key_counts(known).filter("n = 1")
    initials = counts.filter("kind = 'i'").select("case_id", F.col("key").alias("ikey"), F.col("only").alias("_initials"))
    surnames = counts.filter("kind = 's'").select("case_id", F.col("key").alias("skey"), F.col("only").alias("_surname"))
    joined = (
        asked.join(exact, ["case_id", "name"], "left")
        .join(fuzzy, ["case_id", "name"], "left")
        .join(initials, ["case_id", "ikey"], "left")
        .join(surnames, ["case_id", "skey"], "left")
    )
    is_exact = F.col("_exact").isNotNull()
    return joined.select(
        "case_id",
        F.col("name").alias("raw_name"),
        F.when(is_exact, F.col("name")).otherwise(
            F.coalesce("fuzzy", "_initials", "_surname", "name")
        ).alias("canonical_name"),
        F.when(is_exact, 100.0).otherwise(F.col("fuzzy_score")).alias("score"),
        F.when(is_exact, "exact").when(F.col("fuzzy").isNotNull(), "fuzzy")
        .when(F.col("_initials").isNotNull(), "initials").when(F.col("_surname").isNotNull(), "surname")
        .otherwise("new").alias("resolution_type"),
    )


def resolve_and_insert(spark: SparkSession, mentions: DataFrame, known: DataFrame,
                       threshold: float = rules.WITHIN_CASE_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Resolve every distinct mention in turn, longer names first, adding new names as known.

    The outcome is that of one pass per case over the names by (token count descending, name).
    Names are decided in rounds: a name waits only for earlier undecided names of its length
    that could change its outcome, so all cases and nearly all names move together. Returns
    (resolutions, known with ``is_new``).
    """
    work = Workspace(spark, "resolve")
    stored = known.select("case_id", "known").distinct().withColumn("is_new", F.lit(False))
    asked = with_mention_keys(mentions.select("case_id", strip(F.col("name")).alias("name")).distinct())
    full = F.concat_ws("\u0001", *_initial_parts(_plain_tokens(F.col("name"))))
    asked = work.cut(asked.withColumn("kkey", F.when(F.col("ntok") >= 2, full)), "asked")
    lows = asked.select("low").union(stored.select(normalise_text(F.col("known"))))
    pairs = work.cut(similar_names(lows, threshold), "pairs")
    stored = work.cut(stored, "known")
    done = None
    levels = sorted((r[0] for r in asked.select("ntok").distinct().collect()), reverse=True)
    for level in levels:
        open_names = asked.filter(F.col("ntok") == level)
        while True:
            ready = _ready_names(open_names, stored, pairs)
            decided = work.cut(
                resolve(ready.select("case_id", "name"), stored, pairs, threshold), "decided"
            )
            fresh = decided.filter("resolution_type = 'new'").select(
                "case_id", F.col("canonical_name").alias("known"), F.lit(True).alias("is_new")
            )
            before, stored = stored, work.cut(stored.unionByName(fresh), "known")
            work.drop(before)
            done = decided if done is None else done.unionByName(decided)
            closed = decided.select("case_id", F.col("raw_name").alias("name"))
            before, open_names = open_names, work.cut(open_names.join(closed, ["case_id", "name"], "left_anti"), "open")
            work.drop(before)
            if open_names.isEmpty():
                break
    if done is None:
        done = resolve(asked.select("case_id", "name"), stored, pairs, threshold)
    return done, stored


def _ready_names(open_names: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Undecided names of one length whose outcome no earlier undecided name can change."""
    me = open_names.select("case_id", "name", "low", "ikey", "skey")
    other = open_names.select("case_id", F.col("name").alias("other"), F.col("low").alias("low_b"), "ikey", "kkey", "skey")
    first_by_low = other.groupBy("case_id", "low_b").agg(F.min("other").alias("other"))
    same = me.select("low").distinct().select(F.col("low").alias("low_a"), F.col("low").alias("low_b"))
    near = pairs.select("low_a", "low_b").unionByName(same).withColumnRenamed("low_a", "low")
    waits = (
        me.join(near, "low").join(first_by_low, ["case_id", "low_b"])
        .filter(F.col("other") < F.col("name")).select("case_id", "name").distinct()
    )
    # names that enter the key counts of a surname-and-initials key, and those that may do so
    # although a single known name already answers that key
    odd = ~F.col("ikey").eqNullSafe(F.col("kkey"))
    inits = other.filter("kkey IS NOT NULL").groupBy("case_id", F.col("kkey").alias("ikey")).agg(
        F.min("other").alias("_first_i"), F.min(F.when(odd, F.col("other"))).alias("_odd_i")
    )
    snames = other.filter("skey IS NOT NULL").groupBy("case_id", "skey").agg(F.min("other").alias("_first_s"))
    counts = _key_counts(known)
    i_counts = counts.filter("kind = 'i'").select("case_id", F.col("key").alias("ikey"), F.col("n").alias("_n_i"))
    s_counts = counts.filter("kind = 's'").select("case_id", F.col("key").alias("skey"), F.col("n").alias("_n_s"))
    seen = (
        me.join(waits, ["case_id", "name"], "left_anti")
        .join(inits, ["case_id", "ikey"], "left").join(i_counts, ["case_id", "ikey"], "left")
        .join(snames, ["case_id", "skey"], "left").join(s_counts, ["case_id", "skey"], "left")
    )
    n_i, n_s = F.coalesce("_n_i", F.lit(0)), F.coalesce("_n_s", F.lit(0))

    def none_before(first: str) -> Column:
        return F.col(first).isNull() | (F.col(first) >= F.col("name"))

    free_i = none_before("_first_i") | (n_i >= 2) | ((n_i == 1) & none_before("_odd_i"))
    free_s = none_before("_first_s") | (n_s >= 2)
    return seen.filter(free_i & free_s).select("case_id", "name")


def new_values(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct (case_id, label, value) mentions that are not stored yet."""
    stored = entities.select("case_id", "label", F.col("id").alias("value"))
    return mentions.select("case_id", "label", "value").distinct().join(
        stored, ["case_id", "label", "value"], "left_anti"
    )


def known_values(entities: DataFrame, label: str) -> DataFrame:
    """Stored display values of one label: (case_id, known)."""
    return entities.filter((F.col("label") == label) & F.col("value").isNotNull()).select(
        "case_id", F.col("value").alias("known")
    )


# ---------------------------------------------------------------- across cases

EXACT_LABELS = ["Phone", "Vehicle", "Organization"]


def in_cases(entities: DataFrame, case_ids: list[str] | DataFrame | None) -> DataFrame:
    """Keep the given cases: a list, or a (case_id) table of any size."""
    if case_ids is None:
        return entities
    if isinstance(case_ids, DataFrame):
        return entities.join(case_ids.select("case_id"), "case_id", "left_semi")
    return entities.filter(F.col("case_id").isin(list(case_ids)))


def exact_links(entities: DataFrame, case_ids=None) -> DataFrame:
    """Same phone, plate or organisation in two cases; one row per case pair."""
    shared = in_cases(entities, case_ids).filter(
        F.col("label").isin(EXACT_LABELS) & F.col("case_id").isNotNull()
    )
    pairs = tiled_pairs(shared, ["label", "id"], "case_id")
    return pairs.select(
        F.col("label").alias("type"), F.col("case_id_a").alias("case_a"), F.col("id").alias("id_a"),
        F.col("case_id_b").alias("case_b"), F.col("id").alias("id_b"),
        F.lit("exact").alias("match_kind"), F.lit(None).cast("double").alias("score"),
    )


def person_links(entities: DataFrame, case_ids=None, threshold: float = rules.CROSS_CASE_THRESHOLD,
                 same_spelling: bool = True) -> DataFrame:
    """Likely same person in two cases, the smaller (case_id, id) first; ``same_spelling`` adds equal names."""
    persons = in_cases(entities, case_ids).filter(
        (F.col("label") == "Person") & F.col("case_id").isNotNull()
    ).select("case_id", "id", normalise_text(F.col("id")).alias("low")).filter("low <> ''").distinct()
    node = F.struct("case_id", "id")
    pairs = similar_names(persons.select("low"), threshold)
    a = persons.select(node.alias("node_a"), F.col("low").alias("low_a"))
    b = persons.select(node.alias("node_b"), F.col("low").alias("low_b"))
    near = pairs.join(a, "low_a").join(b, "low_b").filter(F.col("node_a") < F.col("node_b"))
    both = near.select("node_a", "node_b", "score")
    if same_spelling:
        same = tiled_pairs(persons.withColumn("node", node), ["low"], "node").withColumn("score", F.lit(100.0))
        both = same.select("node_a", "node_b", "score").unionByName(both)
    return both.filter(F.col("node_a.case_id") != F.col("node_b.case_id")).select(
        F.lit("Person").alias("type"),
        F.col("node_a.case_id").alias("case_a"), F.col("node_a.id").alias("id_a"),
        F.col("node_b.case_id").alias("case_b"), F.col("node_b.id").alias("id_b"),
        F.lit("fuzzy").alias("match_kind"), "score",
    )


def cross_case_links(entities: DataFrame, case_ids=None, threshold: float = rules.CROSS_CASE_THRESHOLD) -> DataFrame:
    return exact_links(entities, case_ids).unionByName(person_links(entities, case_ids, threshold))


def link_groups(entities: DataFrame, case_ids=None) -> DataFrame:
    """Compact form of the exact links: one row per shared value, linear in the entities."""
    shared = in_cases(entities, case_ids).filter(F.col("label").isin(EXACT_LABELS) & F.col("case_id").isNotNull())
    per_value = shared.select("label", "id", "case_id").distinct().groupBy("label", "id").agg(
        F.count(F.lit(1)).alias("case_count"), F.min("case_id").alias("first_case"), F.max("case_id").alias("last_case")
    )
    return per_value.filter("case_count > 1").withColumn(
        "link_count", F.expr("case_count * (case_count - 1) div 2")
    )
