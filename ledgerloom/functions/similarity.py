"""Longest-common-subsequence similarity of short names, 0 to 100."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from ledgerloom.functions.shipping import ship_with_tasks

ship_with_tasks(__name__)


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel dynamic programme: one word operation per character of ``b``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    free = full
    for ch in b:
        hit = free & where.get(ch, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def _best_window(short: str, long: str) -> float:
    m, n = len(short), len(long)
    return max(ratio(short, long[max(0, end - m):min(n, end)]) for end in range(1, n + m))


def score(a: str, b: str) -> float:
    """The better of the whole-name ratio and the best ratio of the shorter name with any window of
    its length in the longer one, windows cut off at either end included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = max(ratio(a, b), _best_window(short, long))
    return max(best, _best_window(long, short)) if len(a) == len(b) else best


def _scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="float64")


def similarity(a: Column, b: Column) -> Column:
    """Score of two name columns, computed on Arrow batches of already distinct pairs."""
    return F.pandas_udf(_scores, "double")(a, b)
