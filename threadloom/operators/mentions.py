"""Mentions in reports: typed values per document and per sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators.cutting import Workspace
from threadloom.operators.substrings import held_values


def submitted_text(reports: DataFrame) -> DataFrame:
    """Per case and batch: all narratives followed by all call texts, as one text."""
    def part(kind: str) -> Column:
        texts = F.array_sort(F.collect_list(F.when(F.col("doc_kind") == kind, F.col("text"))))
        return F.array_join(texts, " \n ")

    return reports.groupBy("case_id", "doc_id").agg(
        F.concat(part("fir"), F.lit(" \n "), part("cdr")).alias("text")
    )


def sentence_table(docs: DataFrame) -> DataFrame:
    """(case_id, doc_id, sent_no, sentence)."""
    cut = docs.select("case_id", "doc_id", tx.sentences(F.col("text")).alias("_sentences"))
    # outer: a filter on empty lists would be moved down and cut the texts twice
    return cut.select("case_id", "doc_id", F.posexplode_outer("_sentences").alias("sent_no", "sentence")).filter("sentence IS NOT NULL")


def said_sentences(docs: DataFrame) -> DataFrame:
    """Each sentence of a case once: (case_id, sentence, n, last), how often it stands there and its last (doc_id, sent_no)."""
    return sentence_table(docs).groupBy("sentence", "case_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "sent_no")).alias("last"))


def pattern_mentions(docs: DataFrame, wide: bool = False) -> DataFrame:
    """Phones, plates and watch-list names of each text as (.., label, value)."""
    body = F.col("text")
    keep = [c for c in docs.columns if c != "text"]
    phones = tx.phone_mentions_wide(body) if wide else tx.phone_mentions(body)
    plates = tx.plate_mentions_wide(body) if wide else tx.plate_mentions(body)
    found = F.concat(
        _tagged("Phone", phones), _tagged("Vehicle", plates), _tagged("Organization", tx.watch_list_mentions(body))
    )
    return docs.select(*keep, F.explode(found).alias("_m")).select(*keep, "_m.label", "_m.value")


def pattern_mentions_by(docs: DataFrame, *keys: str) -> DataFrame:
    """Phones, plates and watch-list names in all texts of a key: (*keys, label, value), some of them repeated.

    Texts of one kind say much the same near their digits: equal parts of a key are searched once, not per text.
    """
    body, part = F.col("text"), F.col("_m.value")
    parts = F.transform(tx.digit_parts(body), lambda p: F.struct(F.lit("").alias("label"), p.alias("value")))
    held = F.concat(parts, _tagged("Organization", tx.watch_list_mentions(body)))
    once = docs.select(*keys, F.explode(held).alias("_m")).distinct()
    numbers = F.concat(_tagged("Phone", tx.phone_mentions(part)), _tagged("Vehicle", tx.plate_mentions(part)))
    found = F.when(F.col("_m.label") == "", numbers).otherwise(F.array("_m"))
    return once.select(*keys, F.explode(found).alias("_m")).select(*keys, "_m.label", "_m.value")


def listed_mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Names of a list of any length (``name``) that occur anywhere in the text: (.., name)."""
    everywhere = names.select(F.lit("").alias("group"), F.col("name").alias("value"), F.lit("").alias("tag"))
    found = held_values(docs.withColumn("_list", F.lit("")), everywhere, "_list", "text")
    return found.drop("_list", "tag").withColumnRenamed("value", "name")


def _tagged(label: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))


def dictionary(names: DataFrame) -> DataFrame:
    """Names (``name`` and any tag columns) with the word key they are matched by."""
    keyed = names.distinct().withColumn("_words", tx.words(F.col("name")))
    return keyed.filter(F.size("_words") > 0).withColumn("_key", F.array_join("_words", " ")).withColumn(
        "_n", F.size("_words")
    ).drop("_words")


def dictionary_mentions(sentences: DataFrame, names: DataFrame, capitalised: bool = False) -> DataFrame:
    """Dictionary names in each sentence, by an equi-join on word runs.

    Only run lengths that occur in the dictionary are generated; scripts and spellings of any case
    count, unless ``capitalised`` asks for an upper-case start. The dictionary is stored first: the optimizer
    broadcasts it when its measured size allows, not that of the table its names come from, and shuffles both sides
    otherwise. Tag columns of the dictionary (such
    as a label) come along.
    """
    lookup, sizes = _lookup(names)
    keep = [c for c in sentences.columns if c != "sentence"]
    worded = sentences.select(*keep, tx.words(F.col("sentence")).alias("_words"))
    keys = F.array_distinct(_runs(F.col("_words"), sizes))
    if capitalised:
        keys = F.filter(keys, lambda k: k.rlike(r"^\p{Lu}"))
    # made before they are exploded: a lambda inside the generator would keep it out of generated code; and outer, as a
    # filter on empty lists would be moved down and make them twice
    made = worded.select(*keep, keys.alias("_keys"))
    return made.select(*keep, F.explode_outer("_keys").alias("_key")).join(lookup.drop("_n"), "_key").select(
        *keep, *names.columns
    )


def _lookup(names: DataFrame) -> tuple[DataFrame, list[int]]:
    """The stored dictionary and the numbers of words its names have."""
    lookup = Workspace(names.sparkSession, "dictionary").cut(dictionary(names), "names")
    return lookup, sorted(r[0] for r in lookup.select("_n").distinct().collect())


def _runs(words: Column, sizes: list[int]) -> Column:
    """All runs of these numbers of words, each word joined to the run before it."""
    found = [F.array().cast("array<string>")]
    for size in sizes:
        count = F.greatest(F.size(words) - (size - 1), F.lit(0))
        made = words if size == 1 else F.slice(words, 1, count)
        for i in range(2, size + 1):
            made = F.zip_with(made, F.slice(words, i, count), lambda run, word: F.concat(run, F.lit(" "), word))
        found.append(made)
    return F.concat(*found)


def candidate_people(docs: DataFrame, column: str = "text") -> DataFrame:
    """Dictionary-free mode: runs of capitalised words, honorifics allowed, cleaned and validated."""
    pattern = r"(?:(?:Smt|Shri|Mr|Mrs)\.\s+)?[A-Z][a-z]+(?:\s[A-Z][a-z]+)+"
    keep = [c for c in docs.columns if c != column]
    found = F.array_distinct(
        F.transform(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0)), tx.clean_person)
    )
    return docs.select(*keep, F.explode(found).alias("name")).filter(tx.is_valid_person(F.col("name")))


def _listed(names: DataFrame, clean, valid) -> DataFrame:
    """Dictionary names with their clean value, where it is valid: cleaned and judged once each, not per mention."""
    return names.select("name", clean(F.col("name")).alias("value")).filter(valid(F.col("value")))


def _listed_people(names: DataFrame) -> DataFrame:
    return _listed(names, tx.clean_person, tx.is_valid_person)


def _listed_places(gazetteer: DataFrame) -> DataFrame:
    return _listed(gazetteer, tx.strip, tx.is_valid_place)


def people(sentences: DataFrame, names: DataFrame) -> DataFrame:
    """Cleaned, valid person mentions per sentence."""
    return dictionary_mentions(sentences, _listed_people(names)).drop("name").withColumnRenamed("value", "name")


def places(sentences: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Valid place mentions per sentence."""
    return dictionary_mentions(sentences, _listed_places(gazetteer)).drop("name").withColumnRenamed("value", "name")


def named_mentions(sentences: DataFrame, names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """People and places per sentence, found in one pass: (.., label, value)."""
    both = _listed_people(names).withColumn("label", F.lit("Person")).unionByName(
        _listed_places(gazetteer).withColumn("label", F.lit("Location")))
    return dictionary_mentions(sentences, both).select(*[c for c in sentences.columns if c != "sentence"], "label", "value")


def document_mentions(docs: DataFrame, names: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """One record of five sorted lists for each document with any mention: (case_id, doc_id, people, locations, ..).

    The texts are read in one pass: the word runs of a document meet the dictionary once each, and its phones, plates
    and organisations come along as lists on one more row, which an empty name in the dictionary lets through.
    """
    lookup, sizes = _lookup(_listed_people(names).withColumn("label", F.lit("Person")).unionByName(
        _listed_places(gazetteer).withColumn("label", F.lit("Location"))))
    known = lookup.select("_key", "label", "value")
    known = known.unionByName(known.sparkSession.range(1).select(*[F.lit("").alias(c) for c in known.columns]))
    body, key = F.col("text"), F.col("_key")
    by_pattern = {"vehicles": tx.plate_mentions(body), "phones": tx.phone_mentions(body), "organizations": tx.watch_list_mentions(body)}
    made = docs.select("case_id", "doc_id", F.transform(tx.sentences(body), tx.words).alias("_words"), *[v.alias(c) for c, v in by_pattern.items()])
    runs = F.flatten(F.transform("_words", lambda words: _runs(words, sizes)))
    keyed = made.select("case_id", "doc_id", *by_pattern, F.array_distinct(F.concat(F.array(F.lit("")), runs)).alias("_keys"))
    rows = keyed.select("*", F.explode_outer("_keys").alias("_key")).drop("_keys").join(known, "_key")
    rows = rows.select("case_id", "doc_id", "label", "value", *[F.when(key == "", F.col(c)).alias(c) for c in by_pattern])
    rows = rows.filter((F.col("label") != "") | (F.size(F.concat(*by_pattern)) > 0))
    named = {"people": "Person", "locations": "Location"}
    return rows.groupBy("case_id", "doc_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("label") == label, F.col("value")))).alias(name) for name, label in named.items()],
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in by_pattern])
