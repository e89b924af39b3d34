"""Words of letters and the hashed buckets of their character n-grams, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

from threadloom.llm import common

#: Lengths of character n-grams, word borders counted as characters.
LENGTHS = (3, 4, 5)
BUCKETS = 1 << 18

_STEP = np.uint64(0x100000001B3)


@cache
def _alphabet() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Letters:
    """Runs of letters in a list of texts, lower-cased: code points with every other character as a border (1)."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        joined = "\n" + "".join(t + "\n" for t in low)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
        letter = _alphabet()[points]
        self.code = np.where(letter, points, 1).astype(np.uint64)
        edge = np.diff(letter.astype(np.int8))
        self.start = np.flatnonzero(edge == 1) + 1
        self.stop = np.flatnonzero(edge == -1) + 1
        self.ends = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])]) + 1
        self.first = np.searchsorted(self.start, self.ends)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.points = points

    def word(self, i: int) -> str:
        return self.points[self.start[i]:self.stop[i]].tobytes().decode("utf-32-le")

    def grams(self) -> Iterator[tuple[int, np.ndarray]]:
        """(length, bucket at each position) for every n-gram length; those outside a word mean nothing."""
        with np.errstate(over="ignore"):
            h = self.code.copy()
            for n in range(2, max(LENGTHS) + 1):
                h = h[:-1] * _STEP + self.code[n - 1:]
                if n in LENGTHS:
                    yield n, self._bucket(h + np.uint64(n))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        power, inverse = common.powers(len(self.code) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.code * power[: len(self.code)])])
            return common.mix((total[self.stop] - total[self.start]) * inverse[self.start])

    def sums(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per word the sum of a table's values over its n-gram buckets, and the number of n-grams."""
        total, count = np.zeros(len(self.start)), np.zeros(len(self.start), np.int64)
        for n, bucket in self.grams():
            run = np.concatenate([[0.0], np.cumsum(table[bucket], dtype=np.float64)])
            own = self.stop - self.start + 3 - n
            has = own > 0
            total[has] += run[(self.stop - n + 2)[has]] - run[(self.start - 1)[has]]
            count += np.maximum(own, 0)
        return total, count

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, 64-bit hash) of every n-gram of one length, borders counted from length two on."""
        h = self.code
        with np.errstate(over="ignore"):
            for j in range(1, n):
                h = h[:-1] * _STEP + self.code[j:]
        border = int(n > 1)
        own = np.maximum(self.stop - self.start + 1 - n + 2 * border, 0)
        word = np.repeat(np.arange(len(own)), own)
        place = np.arange(len(word)) - np.repeat(np.cumsum(own) - own, own) + (self.start - border)[word]
        return word, common.mix(h[place] + np.uint64(n))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, bucket) of every n-gram of every word."""
        words, buckets = [], []
        for n, bucket in self.grams():
            own = np.maximum(self.stop - self.start + 3 - n, 0)
            word = np.repeat(np.arange(len(own)), own)
            place = np.arange(len(word)) - np.repeat(np.cumsum(own) - own, own) + (self.start - 1)[word]
            words.append(word)
            buckets.append(bucket[place])
        return np.concatenate(words), np.concatenate(buckets)

    @staticmethod
    def _bucket(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(46)).astype(np.int64)
