"""The functions by name for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import sequence, text, tree


def register(spark: SparkSession) -> None:
    """Temporary functions: ngrams, jaccard, counter_metric (SQL), and lcs, lcs_coefficient,
    token_levenshtein, gst, struct_compare, pyround (Arrow)."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION ngrams(t ARRAY<STRING>, n INT) RETURNS ARRAY<ARRAY<STRING>>
        RETURN filter(transform(sequence(1, greatest(size(t) - n + 1, 1)), i -> slice(t, i, n)), g -> size(g) = n)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION jaccard(a ARRAY<STRING>, b ARRAY<STRING>, n INT) RETURNS DOUBLE
        RETURN coalesce(try_divide(size(array_intersect(ngrams(a, n), ngrams(b, n))), size(array_union(ngrams(a, n), ngrams(b, n)))), 0.0D)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION counter_metric(a MAP<STRING, INT>, b MAP<STRING, INT>) RETURNS DOUBLE
        RETURN CASE WHEN size(a) = 0 AND size(b) = 0 THEN 1.0D ELSE coalesce(try_divide(
            aggregate(map_values(map_zip_with(a, b, (k, x, y) -> least(coalesce(x, 0), coalesce(y, 0)))), 0L, (s, v) -> s + v),
            aggregate(map_values(map_zip_with(a, b, (k, x, y) -> greatest(coalesce(x, 0), coalesce(y, 0)))), 0L, (s, v) -> s + v)), 0.0D) END""")
    for name, udf in (
        ("lcs", sequence.lcs_udf()), ("lcs_coefficient", sequence.lcs_coefficient_udf()), ("token_levenshtein", sequence.levenshtein_udf()),
        ("gst", sequence.greedy_tiles_udf()), ("struct_compare", tree.struct_compare_udf()), ("pyround", text.python_round()),
    ):
        spark.udf.register(name, udf)
