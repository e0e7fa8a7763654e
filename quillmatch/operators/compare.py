"""Comparison of pairs: fast metrics, the threshold, then structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import counters, grams, tree
from ..schema import DEFAULT_MAX_DEPTH, DEFAULT_NGRAMS, DEFAULT_THRESHOLD, DEFAULT_WEIGHTS

SIDE = ("filepath", "modify_date", "sha256", "head_nodes", "tokens", "operators", "keywords", "literals", "structure")


def fast_metrics(n: int = DEFAULT_NGRAMS, weights=DEFAULT_WEIGHTS, a: str = "a", b: str = "b", jakkar: Column | None = None) -> dict[str, Column]:
    """The four metrics of two feature structs, as expressions; ``jakkar`` if it is known already."""
    return {
        "jakkar": jakkar if jakkar is not None else grams.jaccard(F.col(f"{a}.tokens"), F.col(f"{b}.tokens"), n),
        **{c: counters.counter_metric(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in ("operators", "keywords", "literals")},
    }


def with_sides(pairs: DataFrame, features: DataFrame, columns=SIDE) -> DataFrame:
    """Pairs (first, second) with the feature structs a and b."""
    side = features.select(F.col("filepath").alias("_path"), F.struct(*columns).alias("side"))
    a, b = side.select(F.col("_path").alias("_p1"), F.col("side").alias("a")), side.select(F.col("_path").alias("_p2"), F.col("side").alias("b"))
    return pairs.join(a, F.col("first") == F.col("_p1")).join(b, F.col("second") == F.col("_p2")).drop("_p1", "_p2")


def side_columns(pairs: DataFrame, columns) -> tuple[str, ...]:
    """The columns without the tokens, where the pairs have jakkar."""
    return tuple(c for c in columns if c != "tokens" or "jakkar" not in pairs.columns)


def fast_compare(sides: DataFrame, n: int = DEFAULT_NGRAMS, weights=DEFAULT_WEIGHTS) -> DataFrame:
    """Adds the struct ``fast``. A column jakkar is taken as it is: the search for
    candidates has counted the common n-grams, and tokens need not be joined again."""
    metrics = fast_metrics(n, weights, jakkar=F.col("jakkar") if "jakkar" in sides.columns else None)
    out = sides.withColumns(metrics)
    out = out.withColumn("weighted_average", counters.weighted_average(list(metrics), weights))
    return out.withColumn("fast", F.struct(*metrics, "weighted_average")).drop(*metrics, "weighted_average")


def passes(threshold: int | None, average: Column) -> Column:
    return F.lit(True) if not threshold else average * 100.0 >= threshold


def struct_compare(rows: DataFrame, max_depth: int = DEFAULT_MAX_DEPTH) -> DataFrame:
    """Adds the struct ``structure``; rows with large trees are dealt out evenly."""
    scored = rows.withColumn("_s", tree.struct_compare_udf()(tree.depths(F.col("a.structure"), max_depth), tree.depths(F.col("b.structure"), max_depth)))
    return scored.withColumn("structure", F.struct((F.col("_s.num") / F.col("_s.den")).alias("similarity"), F.col("_s.compliance_matrix").alias("compliance_matrix"))).drop("_s")


def compare_pairs(
    pairs: DataFrame, features: DataFrame, threshold: int | None = DEFAULT_THRESHOLD, n: int = DEFAULT_NGRAMS,
    max_depth: int = DEFAULT_MAX_DEPTH, weights=DEFAULT_WEIGHTS,
) -> DataFrame:
    """compare_info rows of the pairs at or above the threshold.

    The threshold filters on the fast metrics before any tree is compared."""
    fast = fast_compare(with_sides(pairs, features, side_columns(pairs, SIDE)), n, weights)
    kept = fast.where(passes(threshold, F.col("fast.weighted_average")))
    done = struct_compare(kept.repartition("first", "second"), max_depth)
    return done.select(
        F.date_format(F.current_timestamp(), "dd/MM/yyyy HH:mm:ss").alias("date"),
        *[F.col(f"{s}.{c}").alias(f"{name}_{to}") for s, name in (("a", "first"), ("b", "second")) for c, to in (("filepath", "path"), ("modify_date", "modify_date"), ("sha256", "sha256"), ("head_nodes", "heads"))],
        "fast", "structure",
    )
