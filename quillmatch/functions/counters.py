"""Weighted overlap of count maps and the weighted average of the fast metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_WEIGHTS
from .grams import col


def _total(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + x)


def counter_metric(counts1: Column | str, counts2: Column | str) -> Column:
    """Sum of the smaller counts over the sum of the larger ones; 1.0 if both maps are empty."""
    a, b = col(counts1), col(counts2)
    smaller = _total(F.map_zip_with(a, b, lambda _, x, y: F.least(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))))
    larger = _total(a) + _total(b) - smaller
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(larger == 0, F.lit(0.0)).otherwise(smaller.cast("double") / larger)


def weighted_average(metrics: Sequence[Column | str], weights: Sequence[float] = DEFAULT_WEIGHTS) -> Column:
    """Mean of the metrics by weight; terms are added from left to right."""
    if len(metrics) != len(weights):
        raise ValueError("as many weights as metrics are needed")
    total, weight = None, None
    for m, w in zip(metrics, weights):
        term, part = col(m) * F.lit(float(w)), F.lit(float(w))
        total, weight = (term, part) if total is None else (total + term, weight + part)
    return total / weight


def least_jaccard(threshold: int, weights: Sequence[float] = DEFAULT_WEIGHTS) -> float:
    """The Jaccard coefficient that any pair at the threshold (percent) must reach:
    the other metrics are 1 at most."""
    return (threshold / 100 * sum(weights) - sum(weights[1:])) / weights[0]


def count_map(items: Column | str) -> Column:
    """Counts of the items of an array, as a map. The array is read for every
    different item, so a column that stands is cheaper than an expression."""
    x = col(items)
    keys = F.array_distinct(x)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(x) - F.size(F.array_remove(x, k))))
