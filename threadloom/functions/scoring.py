"""Name similarity. Only the character ratio leaves the JVM, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from threadloom.functions.text import normalise_text


@F.pandas_udf(DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio on a 0-100 scale; the argument order matters."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() * 100 for a, b in zip(left, right)], dtype="float64")


def name_tokens(name: Column) -> Column:
    """Distinct lower-case tokens."""
    return F.array_distinct(F.filter(F.split(F.lower(name), r"(?U)\s+"), lambda t: t != ""))


def token_score(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / F.greatest(F.size(a), F.size(b)) * 100


def name_score(left: Column, right: Column) -> Column:
    """100 for equal names, else 0.4 character ratio + 0.6 token overlap."""
    low_l, low_r = normalise_text(left), normalise_text(right)
    tok_l, tok_r = name_tokens(left), name_tokens(right)
    ratio = sequence_ratio(low_l, low_r)
    blank = (F.size(tok_l) == 0) | (F.size(tok_r) == 0)
    return (
        F.when(low_l == low_r, F.lit(100.0))
        .when(blank, ratio)
        .otherwise(ratio * 0.4 + token_score(tok_l, tok_r) * 0.6)
    )
