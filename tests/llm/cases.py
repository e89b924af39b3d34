"""Small tables with every awkward row the operators promise to handle."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    stems = ["ther", "and", "the", "of", "market", "Opened", "late", "quiet", "harbour", "boats", "nets", "ündern", "garçon"]
    return " ".join(draw.choice(stems) + draw.choice(["", "", "s", "ing", ",", "."]) for _ in range(n))


def documents(spark, texts=()):
    """Given texts from id 100 on, then awkward rows; clashing extra columns throughout."""
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "word"), (None, "no id here"), (5, "!!! ... ???"), (6, "x" * 30_000 + " " + prose(1, 6_000)),
             (7, prose(2, 60)), (7, prose(2, 60)), (8, prose(2, 60)), (9, "日本語 текст 😀 é İstanbul ΣΑΣ"), (10, "don't can't <|endoftext|> it's")]
    return spark.createDataFrame([(d, t, None, None, None, 0.5, "k") for d, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
