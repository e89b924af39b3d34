"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its hashed character n-grams, a passage of ``PASSAGE`` words the mean of its
words, and two softmax rows read that mean; a text is as toxic as its most toxic passage, so a few words in a long
text are not averaged away. Vectors and softmax are trained jointly in numpy by Adam on a bounded sample of labelled
texts, starting from the smoothed log odds of the n-grams. Unseen misspellings share most n-grams with known words. As all but the softmax is linear, a fitted model is one number per bucket: a whole text is scored
by summing those over its n-grams, without any vector per word.

Defined results: null and empty texts and texts without letters have the score of the bias alone (texts that say
nothing); rows that repeat are scored alike; without labels of both kinds every score is 0; an empty table gives no
rows; extra columns are kept by ``with_score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import common, subwords

#: Bounds of the fitting sample, in labelled rows of each kind.
TOXIC, CLEAN = 2_500, 4_000
DIMENSIONS = 4
#: Words of a passage; one of fewer than half is averaged as if it had that many.
PASSAGE = 32
#: Averages are small; the softmax reads them this many times enlarged.
GAIN = 64.0
#: N-grams of fewer words of the sample's texts keep a zero vector.
LEAST_WORDS = 8
#: Texts that smooth the log odds of an n-gram.
PRIOR = 8.0
ACCEPT = 0.7


@dataclass
class Model:
    bucket: np.ndarray  # what an n-gram adds, before averaging
    slope: float
    bias: float

    def value(self, texts: list[str]) -> np.ndarray:
        """What the highest passage of each text adds."""
        letters = subwords.Letters(texts)
        total, count = letters.sums(self.bucket)
        passage, first, size = passages(letters)
        once = distinct(passage, letters.hashes())
        z = np.bincount(passage[once], (total / np.maximum(count, 1))[once], minlength=len(size)) / size
        return np.maximum.reduceat(z, first)

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.value(texts) + self.bias, -60, 60)))


def distinct(passage: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One index of each word of each passage, so that a word said over and over does not fill its passage."""
    with np.errstate(over="ignore"):
        key = word.astype(np.uint64) + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(common.mix(key), return_index=True)[1]


def passages(letters: subwords.Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage of each word; first passage of each row (every row has one at least); what to divide each sum by."""
    words = np.diff(letters.first)
    own = np.maximum(-(-words // PASSAGE), 1)
    first = np.cumsum(own) - own
    passage = first[letters.row] + (np.arange(len(letters.row)) - letters.first[:-1][letters.row]) // PASSAGE
    return passage, first, np.maximum(np.bincount(passage, minlength=int(own.sum())), PASSAGE // 2)


def _bags(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(passage, word, share of the passage) of the distinct words of passages, the words, and the first passage of each row."""
    known: dict[str, int] = {}
    where, words, shares, firsts, at = [], [], [], [], 0
    for text in texts:
        letters = subwords.Letters([text])
        passage, _, size = passages(letters)
        firsts.append(at)
        where.append(passage + at)
        own = np.array([known.setdefault(letters.word(i), len(known)) for i in range(len(letters.start))], np.int64)
        once = distinct(passage, own)
        where[-1] = where[-1][once]
        words.append(own[once])
        shares.append(1 / size[passage[once]])
        at += len(size)
    return np.concatenate(where), np.concatenate(words), np.concatenate(shares), list(known), np.array(firsts)


def _odds(text: np.ndarray, word: np.ndarray, ngram_word: np.ndarray, ngram: np.ndarray, y: np.ndarray, n_words: int, n_ngrams: int) -> np.ndarray:
    """Smoothed log odds of an n-gram among toxic against clean texts, by the number of texts of its words."""
    seen = np.unique(text * n_words + word)
    by_kind = [np.bincount(seen[y[seen // n_words] == kind] % n_words, minlength=n_words) for kind in (0, 1)]
    clean, toxic = (np.bincount(ngram, k[ngram_word], minlength=n_ngrams) for k in by_kind)
    share = max(y.sum(), 1) / len(y)
    return np.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share))) - np.log(share / (1 - share))


def train(texts: list[str], toxic: np.ndarray, base_rate: float, rounds: int = 10, rate: float = 0.01, seed: int = 7) -> Model:
    """Joint fit of n-gram vectors and softmax; rows are weighted so that toxic ones make up ``base_rate``.

    Every third text of each kind is kept out of the fit and calibrates its slope and bias.
    """
    place = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic))
    held = (place % 3 == 0) if min(toxic.sum(), (~toxic).sum()) >= 6 else np.zeros(len(toxic), bool)
    held_texts, held_toxic = [t for t, h in zip(texts, held) if h], toxic[held]
    texts, toxic = [t for t, h in zip(texts, held) if not h], toxic[~held]
    passage, word, share, names, firsts = _bags(texts)
    ngram_word, ngram = subwords.Letters(names).pairs() if names else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    per_word = np.maximum(np.bincount(ngram_word, minlength=len(names)), 1)
    spread = np.bincount(ngram, np.bincount(word, minlength=len(names))[ngram_word], minlength=subwords.BUCKETS)
    kept = spread[ngram] >= LEAST_WORDS
    used, ngram = np.unique(ngram[kept], return_inverse=True)
    ngram_word = ngram_word[kept]
    n, y = len(texts), toxic.astype(np.float64)
    n_passages = int(firsts[-1]) + max(1, int(passage.max(initial=0)) - int(firsts[-1]) + 1)
    owner = np.repeat(np.arange(n), np.diff(np.append(firsts, n_passages)))
    weight = np.where(y == 1, base_rate / max(y.sum(), 1), (1 - base_rate) / max((1 - y).sum(), 1))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.02, (len(used), DIMENSIONS))
    softmax = rng.normal(0, 0.1, (2, DIMENSIONS))
    vectors[:, 0] = _odds(owner[passage], word, ngram_word, ngram, y, len(names), len(used)) / 10
    softmax[:, 0] = (-0.5, 0.5)
    bias = np.array([0.0, np.log(base_rate / (1 - base_rate))])
    params = [vectors, softmax, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gather = lambda at, values, size: np.stack(
        [np.bincount(at, values[:, d], minlength=size) for d in range(values.shape[1])], axis=1)
    for t in range(1, rounds + 1):
        means = gather(ngram_word, vectors[ngram], len(names)) / per_word[:, None]
        place = gather(passage, share[:, None] * means[word], n_passages) * GAIN
        z = place @ (softmax[1] - softmax[0])
        top = np.lexsort((z, owner))[np.append(firsts[1:], n_passages) - 1]
        text = place[top]
        logits = text @ softmax.T + bias
        chance = 1 / (1 + np.exp(-np.clip(logits[:, 1] - logits[:, 0], -60, 60)))
        wrong = (weight * (chance - y))[:, None] * np.array([-1.0, 1.0])
        to_text = wrong @ softmax * GAIN
        to_place = np.zeros_like(place)
        to_place[top] = to_text
        to_word = gather(word, share[:, None] * to_place[passage], len(names)) / per_word[:, None]
        to_vector = gather(ngram, to_word[ngram_word], len(used))
        for i, g in enumerate((to_vector, wrong.T @ text + 1e-4 * softmax, wrong.sum(axis=0))):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] -= rate * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.99 ** t)) + 1e-7)
    bucket = np.zeros(subwords.BUCKETS)
    bucket[used] = vectors @ (softmax[1] - softmax[0]) * GAIN
    if not len(held_texts):
        return Model(bucket, 1.0, float(bias[1] - bias[0]))
    value = np.concatenate([Model(bucket, 1.0, 0.0).value(held_texts[i:i + 100]) for i in range(0, len(held_texts), 100)])
    kind = held_toxic.astype(np.float64)
    return Model(bucket, *_calibrate(value, kind, np.where(kind == 1, base_rate / kind.sum(), (1 - base_rate) / (1 - kind).sum())))


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4) -> tuple[float, float]:
    """Slope and bias of the highest passage's value by weighted logistic regression (Newton steps)."""
    center, spread = np.average(z, weights=weight), max(float(z.std()), 1e-9)
    x = np.stack([(z - center) / spread, np.ones(len(z))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (chance - y)) + penalty * w
        hessian = (x * (weight * chance * (1 - chance))[:, None]).T @ x + penalty * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    return float(w[0] / spread), float(w[1] - w[0] * center / spread)


def fit(docs: DataFrame, labels: DataFrame, rows: Column) -> Model | None:
    """Fit on the labelled rows that ``rows`` chooses; labels has doc_id and toxic."""
    marks = labels.filter("toxic is not null").filter(rows).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(r["toxic"]): r["count"] for r in marks.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = F.when(F.col("toxic") == 1, F.lit(TOXIC / counts[1])).otherwise(F.lit(CLEAN / counts[0]))
    drawn = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).withColumnRenamed("doc_id", "labelled_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    picked = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled_id"))  # about TOXIC + CLEAN ids
    sample = picked.select("toxic", "body").toPandas().sort_values("body", kind="stable")
    toxic = sample["toxic"].to_numpy() == 1
    if toxic.all() or not toxic.any():
        return None
    return train(sample["body"].tolist(), toxic, counts[1] / (counts[0] + counts[1]))


def score(spark, model: Model | None, text: str = "text") -> Column:
    """Chance of label 1 for a text column."""
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)  # one number per bucket: 2 MB

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        texts = common.whole(texts)
        parts = [shared.value.score(texts.slice(a, b - a).to_pylist()) for a, b in common.slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return scored(F.col(text))


def with_score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    return docs.withColumn(name, score(docs.sparkSession, model))
