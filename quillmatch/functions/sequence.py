"""Sequence comparison: common subsequence, edit distance, tiling, operator shift."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .grams import col


def lcs(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    if len(b) > len(a):
        a, b = b, a
    code: dict = {}
    y = np.array([code.setdefault(x, len(code)) for x in b], dtype=np.int64)
    row = np.zeros(len(y) + 1, np.int64)
    for x in a:
        hit = y == code.get(x, -1)
        up = row[1:]
        # The best of "match here" and "from above", then the running maximum from the left.
        row[1:] = np.maximum.accumulate(np.maximum(up, np.where(hit, row[:-1] + 1, 0)))
    return int(row[-1])


def lcs_coefficient(a: Sequence, b: Sequence) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if len(a) and len(b) else 0.0


def levenshtein(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences of anything."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def levenshtein_similarity(a: Sequence, b: Sequence) -> float:
    """1 less the distance over the greater length; 1.0 for two empty sequences."""
    longest = max(len(a), len(b))
    return 1 - levenshtein(a, b) / longest if longest else 1.0


def is_occupied(marked: Sequence[int], begin: int, length: int) -> bool:
    """The first or the last position is marked."""
    return begin in marked or begin + length - 1 in marked


def greedy_tiles(a: Sequence, b: Sequence, least: int = 6) -> tuple[list[int], list[int]]:
    """Positions of both sequences covered by greedy tiles of ``least`` or more, in
    the order they were covered.

    Each round takes the longest runs of equal unmarked items, in order of their
    places. Run lengths come from one pass over the diagonals, backwards, so a
    round costs len(a) * len(b).
    """
    n, m = len(a), len(b)
    code: dict = {}
    x = np.array([code.setdefault(v, len(code)) for v in a], dtype=np.int64)
    y = np.array([code.setdefault(v, len(code)) for v in b], dtype=np.int64)
    free_a, free_b = np.ones(n, bool), np.ones(m, bool)
    marked_a: list[int] = []
    marked_b: list[int] = []
    while n and m:
        best, places = least, []
        below = np.zeros(m + 1, np.int64)
        runs = {}
        for p in range(n - 1, -1, -1):
            here = np.zeros(m + 1, np.int64)
            if free_a[p]:
                here[:m] = np.where((y == x[p]) & free_b, below[1:] + 1, 0)
            top = int(here.max())
            if top >= best:
                if top > best:
                    best, runs = top, {}
                runs[p] = np.flatnonzero(here == best)
            below = here
        for p in sorted(runs):
            places += [(p, int(t)) for t in runs[p]]
        for p, t in places:
            if free_a[p] and free_a[p + best - 1] and free_b[t] and free_b[t + best - 1]:
                span = range(best)
                marked_a += [p + k for k in span]
                marked_b += [t + k for k in span]
                free_a[p : p + best] = False
                free_b[t : t + best] = False
        if best <= least:
            return marked_a, marked_b
    return marked_a, marked_b


def operator_shift(a: Sequence, b: Sequence) -> tuple[int, float]:
    """(shift, value) of the best overlap of the shorter sequence slid over the longer."""
    if not len(a) and not len(b):
        return 0, 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = (0, np.float32(0))
    for shift in range(len(long)):
        same = sum(x == y for x, y in zip(short, long[shift:]))
        value = np.float32(same / (len(short) + len(long) - same))
        if value > best[1]:
            best = shift, value
    return best[0], float(best[1])


# Column forms


def op_shift(a: Column | str, b: Column | str) -> Column:
    """struct(shift, value float) as an expression of built-in functions."""
    a, b = col(a), col(b)
    swap = F.size(a) > F.size(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return _shift_of(F.struct(short.alias("s"), long.alias("l")))


def _shift_of(pair: Column) -> Column:
    s, l_ = pair["s"], pair["l"]
    every = F.size(s) + F.size(l_)

    def value(shift: Column) -> Column:
        same = F.size(F.filter(F.zip_with(s, F.slice(l_, shift + 1, F.greatest(F.size(l_), F.lit(1))), lambda x, y: x == y), lambda e: e))
        return F.struct((same.cast("double") / (every - same)).cast("float").alias("value"), (-shift).alias("minus"))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.size(l_) - 1, F.lit(0))), value))
    return F.when(every == 0, F.struct(F.lit(0).alias("shift"), F.lit(1.0).cast("float").alias("value"))).otherwise(
        F.struct((-best["minus"]).cast("int").alias("shift"), best["value"].alias("value"))
    )


def _batch(function, returns):
    @F.pandas_udf(returns)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(list(x), list(y)) for x, y in zip(a, b)])

    return run


def lcs_udf():
    return _batch(lcs, "long")


def lcs_coefficient_udf():
    return _batch(lcs_coefficient, "double")


def levenshtein_udf():
    return _batch(levenshtein, "long")


def greedy_tiles_udf(least: int = 6):
    @F.pandas_udf("first array<int>, second array<int>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([greedy_tiles(list(x), list(y), least) for x, y in zip(a, b)], columns=["first", "second"])

    return run
