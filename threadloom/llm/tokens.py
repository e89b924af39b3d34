"""Token ids of whole texts, kept as a table that later stages read.

The pre-tokenizer of the vocabulary drops white space and never joins characters across it, and its normaliser lowers
case, so the ids of a text are the ids of its lower-cased words in order. A slice of texts is split and its distinct
words are looked up as Arrow arrays; words that the bounded cache lacks go to the tokenizers library, those of a to z
many at a time, since each of them ends in the one id that closes a word. ASCII punctuation behind an ASCII letter or
digit at a word's end is a word of its own. Texts that name an added token of the vocabulary are encoded whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm import common
from threadloom.operators.cutting import Workspace

#: Appended to every document.
END_ID = 2
#: Words that the cache of a process may hold.
CACHE_WORDS = 400_000
#: Text worked on at once; more of it shares more words.
SLICE_BYTES = 4 << 20
#: Words that the library encodes as one text.
TOGETHER = 500
#: Rows of a table with one row per task or range, up to which it is broadcast.
FEW = 1_000_000

# Fixed value: letters of one code point each, whose runs are one pre-token.
RUN = "^[a-zÀ-ÖØ-öø-ÿ]+$"
# Fixed value: ASCII punctuation that a pre-token may consist of; the apostrophe, which starts contractions, is left out.
TAIL = r"([a-z0-9])([!-&(-/:-@\[-`{-~]+)(\s|$)"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of Arrow texts by one vocabulary file."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.closes = np.zeros(1 << 16, bool)
        self.closes[[number for token, number in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._set(pa.array([], pa.large_string()), np.zeros(0, np.uint16), np.zeros(1, np.int64))

    def _set(self, words: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        """The cache: words, and their ids behind each other."""
        self.known, self.ids, self.ends = words, ids, ends

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One per process, so that its cache lasts over tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(got.ids, np.uint16) for got in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(words, ids, ends) of new words, single runs of letters first."""
        plain = pc.match_substring_regex(words, RUN)
        simple, others = words.filter(plain), words.filter(pc.invert(plain))
        joined = [" ".join(simple.slice(i, TOGETHER).to_pylist()) for i in range(0, len(simple), TOGETHER)]
        flat = np.concatenate([np.zeros(0, np.uint16), *self._library(joined)])
        own = self._library(others.to_pylist())
        ends = np.concatenate([[0], np.flatnonzero(self.closes[flat]) + 1, len(flat) + np.cumsum([len(part) for part in own], dtype=np.int64)])
        return pa.concat_arrays([simple, others]), np.concatenate([flat, *own]), ends

    def _looked_up(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words in the cache, which takes in those that it lacks."""
        place = pc.index_in(words, self.known)
        if place.null_count:
            fresh = words.filter(pc.is_null(place))
            if len(self.known) + len(fresh) > CACHE_WORDS:  # start again from the words at hand
                self._set(self.known.slice(0, 0), self.ids[:0], self.ends[:1])
                fresh = words
            fresh, ids, ends = self._learn(fresh)
            self._set(pa.concat_arrays([self.known, fresh]), np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + ends[1:]]))
            place = pc.index_in(words, self.known)
        return place.to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row offsets, ids) with the end id after each row."""
        low = pc.ascii_lower(texts)
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(low, token).to_numpy(zero_copy_only=False)
        if not special.any():
            return self._encode_words(low)
        row_at, parts, row = [np.zeros(1, np.int64)], [], 0
        while row < len(texts):
            stop = row + 1
            while stop < len(texts) and not special[row] and not special[stop]:
                stop += 1
            if special[row]:
                ids = np.append(self._library([texts[row].as_py()])[0], np.uint16(END_ID))
                ends = np.array([0, len(ids)])
            else:
                ends, ids = self._encode_words(low.slice(row, stop - row))
            row_at.append(row_at[-1][-1] + ends[1:])
            parts.append(ids)
            row = stop
        return np.concatenate(row_at), np.concatenate(parts)

    def _encode_words(self, low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(low, TAIL, r"\1 \2\3"))
        coded = split.flatten().dictionary_encode()
        ends = np.asarray(split.offsets, np.int64)
        ends = ends - ends[0]
        place = self._looked_up(coded.dictionary)[np.asarray(coded.indices)]
        begin = self.ends[place]
        length = self.ends[place + 1] - begin
        out_at = np.concatenate([[0], np.cumsum(length)])
        rows = len(ends) - 1
        row_at = out_at[ends] + np.arange(rows + 1)
        ids = np.empty(int(out_at[-1]) + rows, np.uint16)
        ids[row_at[1:] - 1] = END_ID
        kept = np.ones(len(ids), bool)
        kept[row_at[1:] - 1] = False
        ids[kept] = self.ids[np.repeat(begin - out_at[:-1], length) + np.arange(int(out_at[-1]))]
        return row_at, ids


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
])
ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, local = Encoder.of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, docs = common.whole(batch.column("text")), batch.column("doc_id")
            for a, b in common.slices(texts, SLICE_BYTES):
                row_at, ids = encoder.encode(texts.slice(a, b - a))
                n = b - a
                body = pa.Array.from_buffers(pa.binary(), n, [
                    None, pa.py_buffer((row_at * 2).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([
                    docs.slice(a, n), pa.array(np.full(n, part, np.int32)), pa.array(local + row_at[:-1]),
                    pa.array(np.diff(row_at)), body], schema=ARROW)
                local += int(row_at[-1])
                del row_at, ids, body
            pa.default_memory_pool().release_unused()

    return run


def token_table(docs: DataFrame, work: Workspace, path: str | None = None) -> DataFrame:
    """Written once: doc_id, part, local, n_tokens, ids (unsigned 16-bit, little-endian, with the end id).

    ``part`` is the task that encoded the row and ``local`` the ids before it in that task, so the running position
    over all rows needs only the totals of the parts. A null text is empty; rows that repeat stay apart.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = rows.mapInArrow(_encoder(path or vocabulary_path()), SCHEMA)
    where = work.path("tokens")
    coded.write.option("compression", "zstd").parquet(where)
    return docs.sparkSession.read.schema(SCHEMA).parquet(where)


def starts(totals: DataFrame, order: str) -> DataFrame:
    """(order, base): ids before each part; one small row per part."""
    from pyspark.sql import Window

    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(order, F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))


def with_starts(rows: DataFrame, bases: DataFrame, order: str, work: Workspace) -> DataFrame:
    """``rows`` joined with their base; no shuffle of them while there are at most FEW bases."""
    bases = work.cut(bases, "starts")
    return rows.join(F.broadcast(bases) if bases.count() <= FEW else bases, order)


def unpack(binary) -> np.ndarray:
    return np.frombuffer(binary, "<u2")
