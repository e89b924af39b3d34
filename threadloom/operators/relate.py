"""Relationships: sentence co-occurrence and aggregated call and transfer records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import rules
from threadloom.functions import text as tx
from threadloom.operators import resolve as rs
from threadloom.operators.cutting import Workspace
from threadloom.operators.substrings import held_values
from threadloom.operators.upsert import accumulate, entity_rows, latest
from threadloom.schema import EDGE_COLUMNS, EDGE_KEY

# (relationship, source label, target label, trigger needed)
SENTENCE_RULES = [
    ("ASSOCIATE_OF", "Person", "Person", True),
    ("FINANCIAL_TRAIL", "Person", "Person", True),
    ("CDR_LINK", "Person", "Person", True),
    ("SPOTTED_AT", "Person", "Location", False),
    ("ASSOCIATED_WITH", "Person", "Organization", False),
    ("OWNS_VEHICLE", "Person", "Vehicle", True),
    ("USES_DEVICE", "Person", "Phone", True),
    ("INTERCEPTED_CALL", "Phone", "Phone", True),
    ("CAMERA_LOG", "Vehicle", "Location", False),
]
SENTENCE_KEY = ["case_id", "doc_id", "sent_no"]


def fired_triggers(sentence: Column, whole_word: bool = False, rels: list[str] | None = None) -> Column:
    """Names of the relationships, of ``rels`` if given, whose trigger occurs in the sentence."""
    asked = [rel for rel, _, _, gated in SENTENCE_RULES if gated and (rels is None or rel in rels)]
    return tx.triggers_of(sentence, asked, whole_word) if asked else F.array().cast("array<string>")


def _allowed(sentence: Column, whole_word: bool, rels: list[str] | None) -> Column:
    """Relationships that need no trigger and those whose trigger fires."""
    free = [F.lit(rel) for rel, _, _, gated in SENTENCE_RULES if not gated and (rels is None or rel in rels)]
    return F.concat(F.array(*free).cast("array<string>"), fired_triggers(sentence, whole_word, rels)).alias("rels")


def _held(sentences: DataFrame, values: DataFrame, key: list[str]) -> DataFrame:
    found = held_values(
        sentences.select("case_id", *key, "sentence"),
        values.select(F.col("case_id").alias("group"), "value", F.col("label").alias("tag")), "case_id", "sentence")
    return found.select("case_id", *key, F.col("tag").alias("label"), "value")


def sentences_holding(sentences: DataFrame, values: DataFrame) -> DataFrame:
    """Which stored values of the same case occur in a sentence as substrings.

    ``values`` is (case_id, label, value). Sentences pass automata over the values of their case;
    only what they hold is shuffled.
    """
    return _held(sentences, values, SENTENCE_KEY[1:]).distinct()


def _rank(label: Column, value: Column) -> Column:
    """Place in the case list before the name itself: longer names first."""
    return F.when(label == "Person", -F.size(F.split(value, r"(?U)\s+"))).otherwise(F.lit(0))


def canonical_values(named: DataFrame, entities: DataFrame) -> DataFrame:
    """What the named people and places of a case are stored as: (case_id, label, raw, value, rank), stored once."""
    asked = named.filter("label = 'Person'").select("case_id", F.col("value").alias("name")).distinct()
    resolved = rs.resolve(asked, rs.known_values(entities, "Person")).filter("resolution_type <> 'new'")
    people = resolved.select("case_id", F.lit("Person").alias("label"), F.col("raw_name").alias("raw"), F.col("canonical_name").alias("value"))
    places = entities.filter("label = 'Location'").select("case_id", "label", F.col("value").alias("raw"), "value").distinct()
    every = people.unionByName(places).withColumn("rank", _rank(F.col("label"), F.col("value")))
    return Workspace(named.sparkSession, "canonical").cut(every, "values")


def _present(sentences: DataFrame, named: DataFrame, canonical: DataFrame, entities: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Stored people and places by their mentions, and all others as substrings: (case_id, *key, label, value, rank) each."""
    by_name = named.withColumnRenamed("value", "raw").join(canonical, ["case_id", "label", "raw"]).drop("raw")
    others = entities.filter(F.col("label").isin("Vehicle", "Phone", "Organization")).select("case_id", "label", "value")
    held = _held(sentences, others, key).withColumn("rank", F.lit(0))
    return by_name.select(*held.columns), held


def present_entities(sentences: DataFrame, named: DataFrame, canonical: DataFrame, entities: DataFrame) -> DataFrame:
    """All stored entities of the case present in each sentence: (.., label, value).

    People by their resolved mention, places by exact mention, all others as substrings.
    """
    by_name, held = _present(sentences, named, canonical, entities, SENTENCE_KEY[1:])
    people, spots = by_name.filter("label = 'Person'").distinct(), by_name.filter("label = 'Location'")
    return people.unionByName(spots).unionByName(held.distinct()).drop("rank")


def present_items(said: DataFrame, named: DataFrame, canonical: DataFrame, entities: DataFrame) -> DataFrame:
    """All stored entities present in each sentence of a case, as one list in any order: (sid, items)."""
    by_name, held = _present(said, named, canonical, entities, ["sid"])
    return by_name.unionByName(held).groupBy("sid").agg(F.collect_set(F.struct("label", "rank", "value")).alias("items"))


def _fits(a_label: Column, a_item: Column, b_label: Column, b_item: Column) -> Column:
    """Some rule relates the labels; of two alike, the first comes first in the case list."""
    fits = F.lit(False)
    for x, y in sorted({(x, y) for _, x, y, _ in SENTENCE_RULES}):
        pair = (a_label == x) & (b_label == y)
        fits = fits | (pair & (a_item < b_item) if x == y else pair)
    return fits


def _seen(worded: DataFrame, direction: str) -> DataFrame:
    """Pairs of a sentence with its text and the relationships it allows, as sightings."""
    if direction == "mention_order":
        swap = (F.col("src_label") == F.col("dst_label")) & (
            F.instr(F.col("sentence"), F.col("src_id")) > F.instr(F.col("sentence"), F.col("dst_id"))
        )
        worded = worded.withColumns({
            "src_id": F.when(swap, F.col("dst_id")).otherwise(F.col("src_id")),
            "dst_id": F.when(swap, F.col("src_id")).otherwise(F.col("dst_id")),
        })
    allowed = F.lit(False)
    for rel, x, y, _ in SENTENCE_RULES:
        allowed = allowed | ((F.col("src_label") == x) & (F.col("dst_label") == y) & (F.col("rel") == rel))
    seen = worded.withColumn("rel", F.explode("rels")).filter(allowed)
    quoted = F.when(F.col("rel").isin("ASSOCIATE_OF", "FINANCIAL_TRAIL", "CDR_LINK"), F.col("sentence"))
    return seen.select(
        F.col("case_id").alias("src_case"), "src_label", "src_id", "rel",
        F.col("case_id").alias("dst_case"), "dst_label", "dst_id", quoted.alias("source_sentence"), "ord", "n",
    )


def sentence_sightings(sentences: DataFrame, present: DataFrame, whole_word: bool = False,
                       direction: str = "list_order", rels: list[str] | None = None) -> DataFrame:
    """One row per relationship seen in a sentence, all rules in one self-join per sentence.

    Same-label pairs run from the earlier to the later value of the case list: longer names
    first, then by name. ``direction='mention_order'`` uses the position in the sentence.
    Both sides of the self-join are the same shuffled table; the sentence text is joined only to
    the pairs, on the same key.
    """
    rank = _rank(F.col("label"), F.col("value"))
    side = present.select(*SENTENCE_KEY, "label", F.struct(rank.alias("rank"), "value").alias("item"))
    a, b = side.alias("a"), side.alias("b")
    same_sentence = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in SENTENCE_KEY]
    fits = _fits(F.col("a.label"), F.col("a.item"), F.col("b.label"), F.col("b.item"))
    pairs = a.join(b, same_sentence).filter(fits).select(
        *[F.col(f"a.{c}").alias(c) for c in SENTENCE_KEY],
        F.col("a.label").alias("src_label"), F.col("a.item.value").alias("src_id"),
        F.col("b.label").alias("dst_label"), F.col("b.item.value").alias("dst_id"),
    )
    flagged = sentences.select(*SENTENCE_KEY, "sentence", _allowed(F.col("sentence"), whole_word, rels))
    worded = pairs.join(flagged, SENTENCE_KEY).withColumns({"ord": F.struct("doc_id", "sent_no"), "n": F.lit(1).cast("long")})
    return _seen(worded, direction)


def said_sightings(said: DataFrame, items: DataFrame, whole_word: bool = False, direction: str = "list_order",
                   rels: list[str] | None = None) -> DataFrame:
    """As ``sentence_sightings``, one row for all places of a case where the same sentence stands: ``n`` and the last as ``ord``."""
    flagged = said.select("sid", "case_id", "sentence", "n", F.col("last").alias("ord"), _allowed(F.col("sentence"), whole_word, rels))
    # sentences meet their lists, not the pairs of a list
    listed = items.filter(F.size("items") > 1).join(flagged.filter(F.size("rels") > 0), "sid").drop("sid")
    pairs = listed.select("*", F.explode("items").alias("a")).select("*", F.explode("items").alias("b")).drop("items")
    item = lambda side: F.struct(f"{side}.rank", f"{side}.value")
    pairs = pairs.filter(_fits(F.col("a.label"), item("a"), F.col("b.label"), item("b"))).select(
        *[c for c in flagged.columns if c != "sid"], F.col("a.label").alias("src_label"), F.col("a.value").alias("src_id"),
        F.col("b.label").alias("dst_label"), F.col("b.value").alias("dst_id"))
    return _seen(pairs, direction)


# ---------------------------------------------------------------- records


def _case_edges(rows: DataFrame, label: str, rel: str) -> DataFrame:
    return rows.select(
        F.col("case_id").alias("src_case"), F.lit(label).alias("src_label"), "src_id", F.lit(rel).alias("rel"),
        F.col("case_id").alias("dst_case"), F.lit(label).alias("dst_label"), "dst_id",
        *[c for c in rows.columns if c not in ("case_id", "src_id", "dst_id")],
    )


def intercepted_calls(calls: DataFrame) -> DataFrame:
    """Call rows to weighted edges; the last non-blank time and duration win separately."""
    pairs = calls.groupBy("case_id", F.col("caller").alias("src_id"), F.col("called").alias("dst_id")).agg(
        F.count(F.lit(1)).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("source_sentence"),
        latest("ts_raw", "row_no").alias("last_timestamp"),
        latest("duration_raw", "row_no").alias("last_duration"),
    )
    return _case_edges(pairs, "Phone", "INTERCEPTED_CALL").select(*EDGE_COLUMNS)


def call_made(calls: DataFrame) -> DataFrame:
    """One edge per phone pair; the last row wins as a whole."""
    last = calls.groupBy("case_id", F.col("caller").alias("src_id"), F.col("called").alias("dst_id")).agg(
        F.max_by(F.struct("ts_raw", "duration_raw"), "row_no").alias("_last")
    )
    return _case_edges(last, "Phone", "CALL_MADE").select(
        *EDGE_KEY, F.col("_last.ts_raw").alias("last_timestamp"), F.col("_last.duration_raw").alias("last_duration")
    )


def transferred_to(transactions: DataFrame) -> DataFrame:
    """One edge per (from, to, amount, currency); the last row wins, missing accounts are skipped."""
    usable = transactions.filter(
        (F.coalesce("from_account", F.lit("")) != "") & (F.coalesce("to_account", F.lit("")) != "")
    )
    last = usable.groupBy(
        "case_id", F.col("from_account").alias("src_id"), F.col("to_account").alias("dst_id"), "amount", "currency"
    ).agg(F.max_by(F.struct("ts_raw", "description", "kind"), "row_no").alias("_last"))
    return _case_edges(last, "BankAccount", "TRANSFERRED_TO").select(
        *EDGE_KEY, "amount", "currency", F.col("_last.ts_raw").alias("last_timestamp"),
        F.col("_last.description").alias("description"), F.col("_last.kind").alias("kind"),
    )


def narrative_transfers(docs: DataFrame) -> DataFrame:
    """Texts that speak of a transfer: an edge from the first to the second account named."""
    body = F.col("text")
    low = F.lower(body)
    spoken = docs.filter(F.contains(low, F.lit("transfer")) | F.contains(low, F.lit("sent")))
    # as the one element of a list, so that the accounts of a text are searched once for the filter and the result
    found = spoken.select(
        "case_id", "doc_id", body, F.explode_outer(F.array(tx.account_mentions(body))).alias("accounts")
    ).filter(F.size("accounts") >= 2)
    placed = F.array_sort(F.transform("accounts", lambda a: F.struct(F.instr(body, a).alias("at"), a.alias("account"))))
    return found.withColumn("placed", placed).select(
        "case_id", "doc_id", F.get("placed", F.lit(0))["account"].alias("src_id"),
        F.get("placed", F.lit(1))["account"].alias("dst_id"),
        F.lit("TRANSFERRED_TO").alias("rel"), F.lit(0.75).alias("confidence"),
    )


# ---------------------------------------------------------------- nodes of records


def call_entities(calls: DataFrame) -> DataFrame:
    """The phones of call rows as entity rows; without them the call edges have no ends."""
    numbers = calls.select("case_id", F.explode(F.array("caller", "called")).alias("id")).filter("id <> ''").distinct()
    return entity_rows(numbers.withColumn("label", F.lit("Phone")), "tabular_cdr")


def transfer_entities(transactions: DataFrame) -> DataFrame:
    """The accounts of transfer rows as entity rows, those of rows without a counterpart too."""
    accounts = transactions.select("case_id", F.explode(F.array("from_account", "to_account")).alias("id")).filter("id <> ''").distinct()
    return entity_rows(accounts.withColumn("label", F.lit("BankAccount")), "financial_csv")
