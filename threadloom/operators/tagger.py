"""People and places that no dictionary lists, by a sequence tagger learned from those that one does.

Sentences in which a dictionary finds names are the labelled ones. A chain over tokens (begin, inside and outside of
a person or a place) is trained on a bounded sample of them by the averaged structured perceptron (Collins, 2002);
its features are the token, its shape and ending and those of its neighbours. A part of the names goes without its
words in training, so that the chain leans on shapes and neighbours and carries over to names it has not seen.
Weights lie in a table of fixed size by feature hash, which is the broadcast, and are applied in Arrow batches.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.cutting import Workspace
from threadloom.operators.mentions import named_mentions

LABELS = ["Person", "Location"]
TAGS = ["O", *[f"{place}-{label}" for label in LABELS for place in "BI"]]
#: Rows of the weight table (all of it is 1.3 MB).
SLOTS = 1 << 16
#: Labelled sentences to train on, and rounds over them.
SENTENCES, ROUNDS = 3_000, 4
#: Token windows whose gains a tagging task remembers.
WINDOWS = 200_000
#: Share of names whose words a round hides.
HIDDEN = 0.5

TOKEN = r"[\p{L}\p{M}\p{N}_]+(?:['’.-][\p{L}\p{M}\p{N}_]+)*|[^\s]"
SPANS = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.StringType())]))


def tokens(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(TOKEN), F.lit(0))


def shape(token: Column) -> Column:
    """Runs of capitals, small letters and digits as one sign each."""
    signs = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"\p{Lu}+", "\u0001"), r"\p{L}+", "a"), r"\p{N}+", "9")
    return F.replace(signs, F.lit("\u0001"), F.lit("A"))


def tokenised(sentences: DataFrame) -> DataFrame:
    """The sentences with their tokens and shapes."""
    rows = sentences.withColumn("_tokens", F.coalesce(tokens(F.col("sentence")), F.array().cast("array<string>")))
    return rows.withColumn("_shapes", F.transform("_tokens", shape))


def feature_counts(sentences: DataFrame) -> DataFrame:
    """(shape, ending, before, n): how often a token's shape and last letters follow the token before.

    Each token meets only the one before it, not the whole sentence, and equal pairs are counted before they are shaped.
    """
    rows = sentences.select(tokens(F.col("sentence")).alias("_tokens"))
    zipped = F.arrays_zip(F.col("_tokens").alias("token"), F.concat(F.array(F.lit("<s>")), "_tokens").alias("before"))
    pairs = rows.select(F.explode(zipped).alias("_p")).select("_p.token", "_p.before").filter("token IS NOT NULL")
    counted = pairs.groupBy("token", "before").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(
        shape(F.col("token")).alias("shape"), F.lower(F.right("token", F.lit(3))).alias("ending"),
        F.lower("before").alias("before")).agg(F.sum("n").alias("n"))


def _features(words: list[str], shapes: list[str], i: int, hidden: bool = False) -> list[int]:
    """Table rows of a token's features."""
    at = lambda xs, j: xs[j] if 0 <= j < len(xs) else "<s>"
    before, after, own = at(words, i - 1), at(words, i + 1), shapes[i]
    named = [f"s={own}", f"p={before}", f"n={after}", f"ps={at(shapes, i - 1)}", f"ns={at(shapes, i + 1)}", f"pp={at(words, i - 2)}",
             f"s+p={own}|{before}", f"s+n={own}|{after}", f"s+ps={own}|{at(shapes, i - 1)}", f"1={i == 0}|{own}"]
    named += ["w=", "x="] if hidden else [f"w={words[i]}", f"x={words[i][-3:]}"]
    return [crc32(f.encode()) % SLOTS for f in named]


def _window(words: list[str], shapes: list[str], i: int) -> tuple:
    """All that the features of a token look at."""
    return (i == 0, *words[max(i - 2, 0):i + 2], len(words) - i > 1, *shapes[max(i - 1, 0):i + 2], i == 1)


@dataclass
class Model:
    weight: np.ndarray  # SLOTS x tags
    step: np.ndarray  # tags (and start) x tags

    def paths(self, gains: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags of sentences padded to one length: (sentences, tokens, tags) to (sentences, tokens)."""
        count, longest, _ = gains.shape
        best, back = self.step[-1] + gains[:, 0], np.zeros(gains.shape, np.int8)
        for i in range(1, longest):
            ways = best[:, :, None] + self.step[None, :-1]
            more = ways.max(axis=1) + gains[:, i]
            back[:, i] = ways.argmax(axis=1)
            best = np.where((i < lengths)[:, None], more, best)
        tags = np.zeros((count, longest), np.int64)
        now, rows = best.argmax(axis=1), np.arange(count)
        for i in range(longest - 1, -1, -1):
            inside = i < lengths
            tags[inside, i] = now[inside]
            if i:
                now = np.where(inside, back[rows, i, now], now)
        return tags

    def gains(self, sentences: list[tuple[list[str], list[str]]], known: dict[tuple, np.ndarray]) -> np.ndarray:
        """Gains of all tokens, one after the other; those of equal windows are worked out once and kept in ``known``."""
        windows = [_window(*own, j) for own in sentences for j in range(len(own[0]))]
        first: dict[tuple, tuple[list[str], list[str], int]] = {}
        places = ((*own, j) for own in sentences for j in range(len(own[0])))
        for window, place in zip(windows, places):
            if window not in known:
                first.setdefault(window, place)
        if first:
            rows = np.array([_features(*place) for place in first.values()])
            known.update(zip(first, self.weight[rows].sum(axis=1)))
        return np.array([known[window] for window in windows])

    def tag(self, sentences: list[tuple[list[str], list[str]]], known: dict[tuple, np.ndarray] | None = None) -> list[np.ndarray]:
        """Tags of (lower-cased tokens, shapes); ``known`` carries gains from call to call."""
        known = {} if known is None else known
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sentences)
        order = sorted((i for i, (words, _) in enumerate(sentences) if words), key=lambda i: len(sentences[i][0]))
        for a in range(0, len(order), 256):
            part = order[a:a + 256]
            lengths = np.array([len(sentences[i][0]) for i in part])
            if len(known) > WINDOWS:
                known.clear()
            gains = np.zeros((len(part), lengths.max(), len(TAGS)), np.float32)
            gains[np.arange(lengths.max())[None] < lengths[:, None]] = self.gains([sentences[i] for i in part], known)
            for i, tags, n in zip(part, self.paths(gains, lengths), lengths):
                out[i] = tags[:n]
        return out


def _tags(words: list[str], names: list[tuple[str, str]]) -> list[int]:
    """Tags of the names in a sentence, longer names first."""
    out = [0] * len(words)
    low = [w.lower() for w in words]
    for label, name in sorted(names, key=lambda x: -len(x[1])):
        parts = re.findall(r"[\w'’.-]+", name.lower())
        for i in range(len(low) - len(parts) + 1):
            if parts and low[i:i + len(parts)] == parts and not any(out[i:i + len(parts)]):
                out[i] = TAGS.index(f"B-{label}")
                out[i + 1:i + len(parts)] = [TAGS.index(f"I-{label}")] * (len(parts) - 1)
    return out


def train(sample: list[tuple[list[str], list[str], list[int]]], rounds: int = ROUNDS, seed: int = 3) -> Model:
    """Averaged perceptron over (tokens, shapes, tags)."""
    draw, clock = random.Random(seed), 1
    now = Model(np.zeros((SLOTS, len(TAGS)), np.float32), np.zeros((len(TAGS) + 1, len(TAGS)), np.float32))
    drift = Model(np.zeros((SLOTS, len(TAGS))), np.zeros((len(TAGS) + 1, len(TAGS))))
    sample = [(([w.lower() for w in words]), shapes, tags) for words, shapes, tags in sample if words]
    for _ in range(rounds):
        draw.shuffle(sample)
        for words, shapes, tags in sample:
            hide = draw.random() < HIDDEN
            rows = np.array([_features(words, shapes, i, hide and tags[i] > 0) for i in range(len(words))])
            found = now.paths(now.weight[rows].sum(axis=1)[None], np.array([len(words)]))[0]
            if (found == tags).all():
                clock += 1
                continue
            for path, sign in ((tags, 1.0), (found.tolist(), -1.0)):
                for i, tag in enumerate(path):
                    before = path[i - 1] if i else len(TAGS)
                    for model, size in ((now, sign), (drift, sign * clock)):
                        np.add.at(model.weight, (rows[i], tag), size)
                        model.step[before, tag] += size
            clock += 1
    return Model((now.weight - drift.weight / clock).astype(np.float32), (now.step - drift.step / clock).astype(np.float32))


def fit(sentences: DataFrame, names: DataFrame, gazetteer: DataFrame, bound: int = SENTENCES) -> Model:
    """Train on at most ``bound`` sentences in which the dictionaries find a name, drawn by hash."""
    keys = [c for c in sentences.columns if c != "sentence"]
    found = Workspace(sentences.sparkSession, "taught").cut(named_mentions(sentences, names, gazetteer), "found")
    drawn = found.select(*keys).distinct().withColumn("_drawn", F.xxhash64(*keys)).orderBy("_drawn", *keys).limit(bound)
    labels = found.join(F.broadcast(drawn), keys, "left_semi").groupBy(*keys).agg(F.collect_set(F.struct("label", "value")).alias("_names"))
    rows = tokenised(sentences.join(F.broadcast(labels), keys)).select("_tokens", "_shapes", "_names", *keys).orderBy(*keys).collect()
    return train([(r["_tokens"], r["_shapes"], _tags(r["_tokens"], [tuple(n) for n in r["_names"]])) for r in rows])


def _spans(sentence: str, words: list[str], tags: np.ndarray) -> list[dict]:
    out, at, start, label = [], 0, None, None
    for word, tag in zip([*words, ""], [*tags.tolist(), 0]):
        begin = sentence.find(word, at)
        kind = TAGS[tag].partition("-")[2] or None
        if start is not None and (kind != label or TAGS[tag].startswith("B")):
            out.append({"label": label, "value": sentence[start:at]})
            start = None
        if kind and start is None:
            start, label = begin, kind
        at = begin + len(word)
    return out


def tagged_mentions(sentences: DataFrame, model: Model) -> DataFrame:
    """People and places of each sentence: (.., label, value); null and empty sentences have none.

    Tags depend on the words alone: equal sentences are tagged once.
    """
    shared = sentences.sparkSession.sparkContext.broadcast(model)

    known: dict[tuple, np.ndarray] = {}  # of a worker

    @F.arrow_udf(SPANS)
    def spans(text: pa.Array, words: pa.Array, shapes: pa.Array) -> pa.Array:
        rows = list(zip(text.to_pylist(), words.to_pylist(), shapes.to_pylist()))
        tags = shared.value.tag([([w.lower() for w in own], marks) for _, own, marks in rows], known)
        return pa.array([_spans(body or "", own, found) for (body, own, _), found in zip(rows, tags)],
                        pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())])))

    keep = [c for c in sentences.columns if c != "sentence"]
    once = tokenised(sentences.filter("sentence <> ''").select("sentence").distinct())
    # stored before they are filtered: the filter would be moved below the distinct and tag every sentence
    found = once.select("sentence", spans("sentence", "_tokens", "_shapes").alias("_m"))
    found = Workspace(sentences.sparkSession, "tagged").cut(found, "spans").filter(F.size("_m") > 0)
    return sentences.join(found, "sentence").select(*keep, F.explode("_m").alias("_m")).select(*keep, "_m.label", "_m.value").distinct()
