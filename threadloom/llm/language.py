"""Language identification, word first with backoff to character n-grams.

Known words add their log frequency per language. A word never seen falls back to the longest of its character
n-grams (five down to one, word borders included) of which any is known, and adds the mean log frequency of those.
Languages are those of all rows; frequencies are counted by Spark over a bounded sample, drawn per language: all rows
of a language below the quota, a hash sample of a larger one. The tables a task holds are bounded too (``WORDS``,
``NGRAMS``); each language has its own share of them, in which its most frequent entries stay, and what falls out of
the word table is what the n-grams are for. Every row is predicted from its whole text.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text where no language
could be learned; ties go to the language that sorts first; rows that repeat are predicted alike; an empty table
gives no rows; extra columns are kept by ``with_language``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import common, subwords

#: Bound of the sample that frequencies are counted on, in rows over all languages, and the least quota of a language.
ROWS, LEAST_ROWS = 20_000, 100
#: Bounds of the tables over all languages, in distinct words and in distinct n-grams of each length; entries seen once are left out.
WORDS, NGRAMS = 200_000, 50_000
LONGEST = 5
SMOOTH = 0.2
#: A text of this many words or more is as sure as one of this many.
SURE = 12

UNKNOWN = "und"
COUNTS = T.StructType([
    T.StructField("language", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("key", T.LongType()),
    T.StructField("n", T.LongType())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of words (size 0) and n-grams in each batch, by language."""
    for batch in batches:
        texts, languages = common.whole(batch.column("text")), np.array(batch.column("lang").to_pylist())
        for language in np.unique(languages):
            own = texts.filter(pa.array(languages == language))
            for a, b in common.slices(own):
                letters = subwords.Letters(own.slice(a, b - a).to_pylist())
                for size in range(LONGEST + 1):
                    key = letters.ngrams(size)[1] if size else letters.hashes()
                    key, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([str(language)] * len(key), pa.string()), pa.array(np.full(len(key), size, np.int32)),
                        pa.array(key.view(np.int64)), pa.array(n)], names=["language", "size", "key", "n"])


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # per size the sorted hashes
    weights: list[np.ndarray]  # per size a row of log frequencies per key

    def _look(self, size: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys[size], key)
        at = np.minimum(at, max(len(self.keys[size]) - 1, 0))
        known = (self.keys[size][at] == key) if len(self.keys[size]) else np.zeros(len(key), bool)
        return known, at

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language index or -1, score) of each text."""
        letters = subwords.Letters(texts)
        unique, where, code = np.unique(letters.hashes(), return_index=True, return_inverse=True)
        weight = np.zeros((len(unique), len(self.languages)))
        known, at = self._look(0, unique)
        weight[known] = self.weights[0][at[known]]
        left = np.flatnonzero(~known)
        for size in range(LONGEST, 0, -1):
            if not len(left):
                break
            word, key = subwords.Letters([letters.word(where[i]) for i in left]).ngrams(size)
            hit, at = self._look(size, key)
            word, at = word[hit], at[hit]
            n = np.bincount(word, minlength=len(left))
            for j in range(len(self.languages)):
                weight[left, j] = np.bincount(word, self.weights[size][at, j], minlength=len(left)) / np.maximum(n, 1)
            left = left[n == 0]
        words = np.diff(letters.first)
        total = np.stack([np.bincount(letters.row, weight[code, j], minlength=len(texts)) for j in range(len(self.languages))], axis=1)
        mean = total / np.maximum(words, 1)[:, None]
        best = mean.argmax(axis=1)
        z = (mean - mean.max(axis=1, keepdims=True)) * np.minimum(words, SURE)[:, None]
        chance = 1 / np.exp(z).sum(axis=1)
        return np.where(words > 0, best, -1), np.where(words > 0, chance, 0.0)


def quota_of(sizes: Iterable[int], bound: int) -> int:
    """The largest quota with which groups of these sizes, each cut to it, have at most ``bound`` rows together."""
    left, rest = bound, sorted(sizes)
    for i, n in enumerate(rest):
        if n * (len(rest) - i) > left:
            return left // (len(rest) - i)
        left -= n
    return bound


def fit(docs: DataFrame, rows: Column) -> Model | None:
    """Learn from text and lang of the rows that ``rows`` chooses."""
    known = docs.select("doc_id", "text", "lang").filter(rows).filter("lang is not null and text is not null")
    rows_of = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(rows_of)
    if not languages:
        return None
    quota = max(quota_of(rows_of.values(), ROWS), LEAST_ROWS)
    shares = [F.lit(x) for name, n in rows_of.items() if n > quota for x in (name, quota / n)]
    if shares:
        share = F.coalesce(F.create_map(*shares)[F.col("lang")], F.lit(1.0))
        known = known.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < share * (1 << 40))
    counts = known.select("text", "lang").mapInArrow(_count, COUNTS)
    spread = counts.groupBy("size", "key", "language").agg(F.sum("n").alias("n"))
    table = spread.groupBy("size", "key").agg(F.collect_list(F.struct("language", "n")).alias("by"), F.sum("n").alias("n")).filter("n > 1")
    table = table.persist()
    entries = table.select("size", F.explode("by.language").alias("language")).groupBy("size", "language").count().collect()
    place = {name: i for i, name in enumerate(languages)}
    keys, weights = [], []
    for size in range(LONGEST + 1):
        have = {r["language"]: r["count"] for r in entries if r["size"] == size}
        quota = max(quota_of(have.values(), NGRAMS if size else WORDS), 1)
        kept = {}
        for name in have:
            own = table.filter(F.col("size") == size).select("key", "by", F.get(F.filter("by", lambda x: x["language"] == name), F.lit(0))["n"].alias("own"))
            top = own.filter("own is not null").orderBy(F.desc("own"), "key").limit(quota).select("key", "by").collect()
            kept.update((r["key"], r["by"]) for r in top)
        key = np.array(list(kept), np.int64).view(np.uint64)
        n = np.zeros((len(kept), len(languages)))
        for i, by in enumerate(kept.values()):
            for x in by:
                n[i, place[x["language"]]] = x["n"]
        order = np.argsort(key)
        keys.append(key[order])
        weights.append(np.log((n[order] + SMOOTH) / (n.sum(axis=0) + SMOOTH * max(len(n), 1))))
    table.unpersist()
    return Model(languages, keys, weights)


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_PREDICTED_ARROW = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predict(spark, model: Model | None, text: str = "text") -> Column:
    """struct(lang_pred, score) of a text column."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)  # WORDS + LONGEST * NGRAMS rows at most

    @F.arrow_udf(PREDICTED)
    def predicted(texts: pa.Array) -> pa.Array:
        texts = common.whole(texts)
        names = np.array([*shared.value.languages, UNKNOWN], object)
        best, chance = [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b in common.slices(texts):
            i, p = shared.value.predict(texts.slice(a, b - a).to_pylist())
            best.append(i)
            chance.append(p)
        return pa.StructArray.from_arrays(
            [pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(chance))], fields=list(_PREDICTED_ARROW))

    return predicted(F.col(text))


def with_language(docs: DataFrame, model: Model | None) -> DataFrame:
    mark = common.free_name(docs, "predicted_")
    out = docs.withColumn(mark, predict(docs.sparkSession, model))
    return out.withColumns({"lang_pred": F.col(mark)["lang_pred"], "score": F.col(mark)["score"]}).drop(mark)
