"""Spelling variants by finite-state composition.

Words that differ by exactly one inserted, deleted or replaced code point are what the composition of the vocabulary
acceptor, a one-edit transducer and the acceptor again accepts. The acceptor is cut at its initial states: words that
share their first ``PREFIX`` code points start in one state and form a block, whose minimal acceptor is built and
composed in one task. A pair whose words differ within these code points agrees in the last ones, as words have
``LEAST_LENGTH`` at least, so the same is done on reversed words, keeping those pairs alone. A block of more than
``BLOCK`` words is opened: the states behind its next code point become initial states of their own, and pairs edited
at that very place meet by a join on what follows it. No block, and no group of that join, grows with the corpus.

Defined results: a null text has no words; a row without an id counts as one with an empty id; rows that repeat count
each; an empty table, or one without frequent words, gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.cutting import Workspace

#: Runs of these letters are words; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A run loses one code point where its checksum is divisible by this.
SLIPS = 199
#: A form is at least this many times as frequent as its variant.
RATIO = 5
#: Code points that words of a block share, twice of which no word is shorter than.
PREFIX = 3
#: Words of which a block is composed at once.
BLOCK = 20_000


def frequent_words(docs: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of ``length`` code points or more that occur ``count`` times or more, slips of the pen included."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{length},}})")))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), runs.alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = found.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", upper, upper.lower())).otherwise(F.col("run")))
    found = found.withColumn("drawn", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    place = F.pmod("drawn", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    words = found.select(F.when(F.pmod("drawn", F.lit(SLIPS)) == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count)


# ---------------------------------------------------------------- automata of a block


class Acceptor:
    """The minimal acceptor of sorted distinct words; every state has a larger number than its successors."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False, {}]]
        letters: list[str] = []

        def close(depth: int) -> None:
            while len(letters) > depth:
                ends, arcs = path.pop()
                key = (ends, tuple(arcs.items()))
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.final)
                    self.final.append(ends)
                    self.arcs.append(arcs)
                path[-1][1][letters.pop()] = state

        for word in words:
            same = 0
            for a, b in zip(letters, word):
                if a != b:
                    break
                same += 1
            close(same)
            for letter in word[same:]:
                letters.append(letter)
                path.append([False, {}])
            path[-1][0] = True
        close(0)
        self.start = len(self.final)
        self.final.append(path[0][0])
        self.arcs.append(path[0][1])
        self.apart: set[tuple[int, int]] = set()
        self.meet: set[tuple[int, int]] = set()

    def meets(self, p: int, q: int) -> bool:
        """Some string is accepted from both states."""
        if p == q or (p, q) in self.meet:
            return True
        stack, seen = [(p, q)], set()
        while stack:
            pair = stack.pop()
            if pair in seen or pair in self.apart:
                continue
            x, y = pair
            if x == y or pair in self.meet or (self.final[x] and self.final[y]):
                self.meet.add((p, q))
                return True
            seen.add(pair)
            left, right = self.arcs[x], self.arcs[y]
            if len(left) > len(right):
                left, right = right, left
                stack += [(right[c], s) for c, s in left.items() if c in right]
            else:
                stack += [(s, right[c]) for c, s in left.items() if c in right]
        self.apart |= seen
        return False

    def shared(self, p: int, q: int) -> Iterator[str]:
        """The strings accepted from both states."""
        stack = [(p, q, "")]
        while stack:
            x, y, text = stack.pop()
            if self.final[x] and self.final[y]:
                yield text
            right = self.arcs[y]
            for c, s in self.arcs[x].items():
                if c in right and self.meets(s, right[c]):
                    stack.append((s, right[c], text + c))

    def edits(self, state: int) -> list[tuple[str, str, int, int]]:
        """What the transducer may do in a state: (letter read, letter written or '', states after it)."""
        arcs, out = list(self.arcs[state].items()), []
        for i, (a, p) in enumerate(arcs):
            out += [(a, b, p, q) for b, q in arcs[i + 1:] if self.meets(p, q)]
            # a deletion in a run of equal letters counts at its last one only
            if (self.final[p] and self.final[state]) or any(
                    c != a and c in self.arcs[p] and self.meets(self.arcs[p][c], q) for c, q in arcs):
                out.append((a, "", p, state))
        return out

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Each pair of accepted words one edit apart, once."""
        here = [self.edits(state) for state in range(len(self.final))]
        fruitful = [False] * len(here)
        for state, edits in enumerate(here):
            fruitful[state] = bool(edits) or any(fruitful[s] for s in self.arcs[state].values())
        stack = [(self.start, "")]
        while stack:
            state, text = stack.pop()
            for a, b, p, q in here[state]:
                for rest in self.shared(p, q):
                    if b or not rest.startswith(a):
                        yield text + a + rest, text + b + rest
            stack += [(s, text + c) for c, s in self.arcs[state].items() if fruitful[s]]


PAIRS = T.StructType([T.StructField("word", T.StringType()), T.StructField("near", T.StringType()), T.StructField("near_n", T.LongType())])
PAIRS_ARROW = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _composed(backwards: bool):
    def of_block(words: dict[str, int]) -> pa.RecordBatch:
        found = []
        if len(words) > 1:
            for x, y in Acceptor(sorted(words)).pairs():
                nx, ny = words[x], words[y]
                if backwards:
                    x, y = x[::-1], y[::-1]
                    if x[:PREFIX] == y[:PREFIX]:
                        continue
                found += [(x, y, ny), (y, x, nx)]
        columns = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAIRS_ARROW)], schema=PAIRS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, {}
        for batch in batches:
            for key, text, n in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "n"))):
                if key != now:
                    yield of_block(words)
                    now, words = key, {}
                words[text] = n
        yield of_block(words)

    return run


def _after(text: Column, depth: int) -> Column:
    """What follows the first ``depth`` code points."""
    return F.substring(text, F.lit(depth + 1), F.length(text))


def _edited_at(rows: DataFrame, depth: int) -> DataFrame:
    """Pairs (x, y) of an opened block that differ at the code point behind their common ``depth`` ones."""
    text = F.col("text")
    own = rows.select("key", "text", "n", F.substring(text, depth + 1, 1).alias("letter"), _after(text, depth + 1).alias("rest"), _after(text, depth).alias("all"))
    left, right = own.alias("l"), own.filter("letter <> ''").alias("r")
    changed = left.filter("letter <> ''").join(right, F.expr("l.key = r.key AND l.rest = r.rest AND l.letter < r.letter"))
    gone = left.join(right, F.expr("l.key = r.key AND l.all = r.rest AND substring(r.rest, 1, 1) <> r.letter"))
    columns = [F.col("l.text").alias("x"), F.col("l.n").alias("nx"), F.col("r.text").alias("y"), F.col("r.n").alias("ny")]
    return changed.select(columns).unionByName(gone.select(columns))


def _pairs_one_way(words: DataFrame, backwards: bool, block: int, work: Workspace) -> list[DataFrame]:
    text = F.reverse("word") if backwards else F.col("word")
    rows, depth, found = words.select(text.alias("text"), "n"), PREFIX, []
    rows = rows.withColumn("key", F.substring("text", 1, depth))
    while True:
        hot = work.cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block).drop("size"), "hot")
        none_hot = hot.isEmpty()
        small = rows if none_hot else rows.join(hot, "key", "left_anti")
        found.append(work.cut(small.repartition("key").sortWithinPartitions("key").mapInArrow(_composed(backwards), PAIRS), "pairs"))
        if none_hot:
            return found
        rows = work.cut(rows.join(hot, "key", "left_semi"), "opened")
        met = _edited_at(rows, depth)
        if backwards:
            met = met.withColumns({"x": F.reverse("x"), "y": F.reverse("y")}).filter(
                F.substring("x", 1, PREFIX) != F.substring("y", 1, PREFIX))
        met = work.cut(met, "edited")
        found.append(met.select(F.col("x").alias("word"), F.col("y").alias("near"), F.col("ny").alias("near_n")))
        found.append(met.select(F.col("y").alias("word"), F.col("x").alias("near"), F.col("nx").alias("near_n")))
        depth += 1
        rows = rows.filter(F.length("text") >= depth).withColumn("key", F.substring("text", 1, depth))


def near_pairs(words: DataFrame, work: Workspace, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): all ordered pairs of the words (word, n) that are one edit apart."""
    every = _pairs_one_way(words, False, block, work) + _pairs_one_way(words, True, block, work)
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


# ---------------------------------------------------------------- groups


def _roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """(word, root): the last of each chain of forms, by pointer jumping; counts rise along a chain, so it ends."""
    now = work.cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jump = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = Observation()
        after = now.join(jump, F.col("root") == F.col("at"), "left").observe(moved, F.count("next").alias("n")).select(
            "word", F.coalesce("next", "root").alias("root"))
        now = work.cut(after, "roots")
        if not moved.get["n"]:
            return now


def variants(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per frequent word: word, form, root, n, n_near, form_n."""
    work = Workspace(docs.sparkSession, "spelling")
    words = work.cut(frequent_words(docs), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words, work, block).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left").withColumn("form_n", -F.col("best.rank"))
    has_form = F.col("form_n") >= F.col("n") * RATIO
    known = work.cut(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has_form, F.col("best.near")).alias("form"),
        F.when(has_form, F.col("form_n")).alias("form_n")), "forms")
    roots = _roots(known.filter("form IS NOT NULL"), work)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
