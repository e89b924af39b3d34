"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text give the non-negative unbiased risk
``prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))`` under the logistic loss, minimised over a
linear model of binned text measures. The loss is proper, so the score is an estimate of the chance of label 1.
Labelled zeros are used for one thing only, the class prior; without any, the prior comes from the ratio of mean
scores of unlabelled and positive rows of a labelled-or-not model.

Measures are taken over whole texts, in Arrow batches. Fitting uses bounded samples (``POSITIVES``, ``UNLABELLED``) of
their measures, drawn by hash from all rows; scoring covers every row.

Defined results: null and empty texts have zero measures and are scored like any other; rows that repeat are scored
alike; without a positive label every score is 0.5; an empty table gives no rows; extra columns are kept by
``with_score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import common

#: Bounds of the fitting samples, in rows.
POSITIVES = 20_000
UNLABELLED = 40_000
#: Bins per measure, their edges being quantiles of the unlabelled sample.
BINS = 24
#: Score from which a document is accepted.
ACCEPT = 0.7

SPACES = common.byte_classes(gap=b" \t\n\v\f\r")
# Byte classes whose shares are measures.
GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\r\n", b".,;:", b"!?", b"|/\\<>_=~^",
          b"*#$%&@+", b"\"'()[]{}-", bytes(range(128, 256))]
MEASURES = len(GROUPS) + 10


def measures(texts: pa.Array) -> np.ndarray:
    """One row of measures per text."""
    data, ends = common.raw(texts)
    rows = len(texts)
    out = np.zeros((rows, MEASURES), np.float32)
    size = np.diff(ends).astype(np.float64)
    some = np.maximum(size, 1)
    kind = np.full(256, len(GROUPS), np.uint8)
    for g, members in enumerate(GROUPS):
        kind[list(members)] = g
    coded = kind[data]
    owner = np.repeat(np.arange(rows), np.diff(ends)) * (len(GROUPS) + 1)
    counts = np.bincount(owner + coded, minlength=rows * (len(GROUPS) + 1)).reshape(rows, -1)
    out[:, : len(GROUPS)] = counts[:, : len(GROUPS)] / some[:, None]
    words = common.Words(texts, SPACES)
    n = np.diff(words.first)
    many = np.maximum(n, 1)
    length = words.stop - words.start
    last = kind[words.low[words.stop - 1]] if len(words.stop) else np.zeros(0, np.uint8)
    same = np.zeros(len(n), np.float64)
    if len(length) > 1:
        again = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
        same = np.bincount(words.row[1:], again, minlength=rows)
    pair = common.mix(words.hash + words.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(words.row[np.unique(pair, return_index=True)[1]], minlength=rows) if len(pair) else np.zeros(rows)
    per_word = lambda mask: np.bincount(words.row, mask, minlength=rows) / many
    symbol = (last >= 6) & (last <= 8)
    out[:, len(GROUPS):] = np.stack([
        np.log1p(n), np.bincount(words.row, length, minlength=rows) / many, per_word(length <= 3), per_word(length >= 12),
        same / many, distinct / many, distinct / np.sqrt(many), per_word(symbol), per_word(symbol & (length == 1)),
        counts[:, 4] / many,
    ], axis=1)
    return out


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _measured(texts: pa.Array) -> pa.Array:
    texts = common.whole(texts)
    parts = [measures(texts.slice(a, b - a)) for a, b in common.slices(texts)]
    flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0, np.float32)
    return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, MEASURES, dtype=np.int32), pa.array(flat, pa.float32()))


@dataclass
class Model:
    edges: np.ndarray  # measure x BINS - 1
    weights: np.ndarray  # measure x BINS
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.weights[np.arange(len(self.edges)), self.bins(x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-z))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, negative_part: bool = True,
         rounds: int = 600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Adam on the non-negative risk; ``negative_part=False`` tells labelled from unlabelled rows instead."""
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    model = Model(np.quantile(unlabelled, cuts, axis=0).T.astype(np.float32), np.zeros((MEASURES, BINS)), 0.0)
    offset = np.arange(MEASURES) * BINS
    cells = [model.bins(x) + offset for x in (positive, unlabelled)]
    flat = np.zeros(MEASURES * BINS + 1)
    first, second = np.zeros_like(flat), np.zeros_like(flat)

    def chance(at):
        return 1 / (1 + np.exp(-np.clip(flat[at].sum(axis=1) + flat[-1], -40, 40)))

    def gradient(at, per_row):
        g = np.bincount(at.reshape(-1), np.repeat(per_row, MEASURES), minlength=len(flat))
        g[-1] = per_row.sum()
        return g

    for t in range(1, rounds + 1):
        p, u = chance(cells[0]), chance(cells[1])
        if negative_part:
            rest = -np.log1p(-np.minimum(u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(p, 1 - 1e-12)).mean()
            minus = gradient(cells[1], u / len(u)) - prior * gradient(cells[0], p / len(p))
            if rest >= 0:
                g = prior * gradient(cells[0], (p - 1) / len(p)) + minus
            else:  # step back until the estimated negative risk is a risk again
                g = -minus
        else:
            g = gradient(cells[0], (p - 1) / (len(p) + len(u))) + gradient(cells[1], u / (len(p) + len(u)))
        g[:-1] += decay * flat[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        flat -= rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    model.weights, model.bias = flat[:-1].reshape(MEASURES, BINS), float(flat[-1])
    return model


def sampled(df: DataFrame, total: int, bound: int) -> DataFrame:
    """About ``bound`` rows of ``total``, chosen by a hash of the row's id and text."""
    if total <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int((1 << 20) * bound / total))


def fit(docs: DataFrame, labels: DataFrame, train: Column, prior: float | None = None) -> Model | None:
    """Fit on the rows of ``docs`` (doc_id, text) that ``train`` chooses; labels has doc_id and quality."""
    rows = docs.select("doc_id", "text").filter(train)
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n_rows = rows.count()
    known = marks.filter(train).agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("ones")).first()
    ones = int(known["ones"] or 0)
    if not ones or not n_rows:
        return None
    good = marks.filter("quality = 1").filter(train)
    drawn = good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, POSITIVES / ones)))
    drawn = drawn.select(F.col("doc_id").alias("labelled_id"))
    picked = rows.join(F.broadcast(drawn), F.col("doc_id") == F.col("labelled_id"), "left_semi")  # about POSITIVES ids
    collect = lambda df: np.array([r[0] for r in df.select(_measured("text")).collect()], np.float32)
    positive, unlabelled = collect(picked), collect(sampled(rows, n_rows, UNLABELLED))
    if not len(positive) or not len(unlabelled):
        return None
    if prior is None:
        prior = ones / known["n"]
        if known["n"] == ones:
            told = _fit(positive, unlabelled, 0.5, negative_part=False, rounds=200)
            prior = float(told.score(unlabelled).mean() / max(told.score(positive).mean(), 1e-6))
        prior = min(max(prior, 0.01), 0.99)
    return _fit(positive, unlabelled, prior)


def score(model: Model | None, text: str = "text") -> Column:
    """Chance of label 1 for a text column."""

    @F.arrow_udf(T.DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        texts = common.whole(texts)
        parts = [model.score(measures(texts.slice(a, b - a))) for a, b in common.slices(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return scored(F.col(text)) if model else F.lit(0.5)


def with_score(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    return docs.withColumn(name, score(model))
