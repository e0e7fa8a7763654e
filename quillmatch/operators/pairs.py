"""Which works are compared.

At a threshold above 54 percent (with the default weights) any pair that can
survive shares an n-gram, so candidates come from an equi-join on n-grams: an
exact inverted index (:mod:`overlap`). The least Jaccard coefficient that the
threshold implies bounds the sizes and the places where a pair can meet, and lets
each work leave its most frequent grams out of it. At lower thresholds, or none, every pair has to be compared, by definition.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.counters import least_jaccard
from ..functions.grams import hashed_ngrams
from ..schema import DEFAULT_NGRAMS, DEFAULT_WEIGHTS, MODES
from .overlap import overlaps

SLACK = 1e-9


def iterations(count: int | Column, mode: str) -> int | Column:
    """Comparisons of ``count`` works (many_to_many) or collections (one_to_one)."""
    if mode not in MODES:
        raise ValueError(f"the mode must be one of {MODES}")
    if isinstance(count, Column):
        n = count.cast("long")
        # One of the factors is even; halved first, so that the product fits wherever the result does.
        return F.when(n < 2, F.lit(0).cast("long")).when(n % 2 == 0, (n / 2).cast("long") * (n - 1)).otherwise(n * ((n - 1) / 2).cast("long"))
    return comb(count, 2) if count > 1 else 0


def shared_grams(features: DataFrame, least: float, n: int = DEFAULT_NGRAMS, mode: str = "many_to_many", names: DataFrame | None = None) -> DataFrame:
    """(first, second, n_common, n_first, n_second) of all pairs whose Jaccard
    coefficient is at least ``least`` > 0. Rows with one path are one work. ``names``, if
    given, has a row for each of them: key (the path in the features), filepath (the path
    to report, another for each key) and collection_id."""
    identity = F.xxhash64("filepath").alias("id")
    met = overlaps(features.select(identity, hashed_ngrams("tokens", n, unique=True).alias("grams")), least)
    if names is None:
        names = features.select(F.col("filepath").alias("key"), "filepath", "collection_id").dropDuplicates(["key"])
    names = names.select(F.xxhash64("key").alias("id"), "filepath", "collection_id")
    side = lambda k: names.select(F.col("id").alias(k), F.col("filepath").alias(f"p_{k}"), F.col("collection_id").alias(f"c_{k}"))
    both = met.join(side("a"), "a").join(side("b"), "b")
    order = ("c_a", "c_b") if mode == "one_to_one" else ("p_a", "p_b")
    swap = F.col(order[1]) < F.col(order[0])
    turned = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return both.where(F.col(order[0]) != F.col(order[1])).select(
        turned("p_a", "p_b").alias("first"), turned("p_b", "p_a").alias("second"), "n_common", turned("n_a", "n_b").alias("n_first"), turned("n_b", "n_a").alias("n_second")
    )


def all_pairs(features: DataFrame, mode: str = "many_to_many") -> DataFrame:
    """Every pair: what comparing without a threshold means."""
    a = features.select(F.col("filepath").alias("first"), F.col("collection_id").alias("c1"))
    b = features.select(F.col("filepath").alias("second"), F.col("collection_id").alias("c2"))
    on = (F.col("c1") < F.col("c2")) & (F.col("first") != F.col("second")) if mode == "one_to_one" else F.col("first") < F.col("second")
    return a.join(b, on).select("first", "second")


def scored_candidates(features: DataFrame, threshold: int | None, n: int = DEFAULT_NGRAMS, mode: str = "many_to_many", weights=DEFAULT_WEIGHTS, names: DataFrame | None = None) -> DataFrame:
    """(first, second) in order of path: every pair that can reach the threshold; with
    jakkar, their Jaccard coefficient, where the search has counted it."""
    if mode not in MODES:
        raise ValueError(f"the mode must be one of {MODES}")
    least = least_jaccard(threshold, weights) if threshold else 0.0
    ordered = [F.least("first", "second").alias("first"), F.greatest("first", "second").alias("second")]
    if least <= SLACK:
        return all_pairs(features, mode).select(*ordered).distinct()
    jakkar = F.col("n_common").cast("double") / (F.col("n_first") + F.col("n_second") - F.col("n_common"))
    return shared_grams(features, least, n, mode, names).select(*ordered, jakkar.alias("jakkar")).distinct()


def candidates(features: DataFrame, threshold: int | None, n: int = DEFAULT_NGRAMS, mode: str = "many_to_many", weights=DEFAULT_WEIGHTS) -> DataFrame:
    """(first, second) of :func:`scored_candidates`."""
    return scored_candidates(features, threshold, n, mode, weights).select("first", "second")
