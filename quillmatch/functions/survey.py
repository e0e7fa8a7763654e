"""Figures of the timing surveys: corpora, means, trends, rolling means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import text_lengths, without_blank_lines

CORPUS = "_index string, content string, link string, extension string, repo_name string, content_len long, content_len_without_blank long, count_lines_without_blank_lines long"


def corpus_rows(works: DataFrame, repo_name: str, extension: str = "py", min_lines: int = 5) -> DataFrame:
    """Works of a repository with their lengths, those with more than ``min_lines`` lines."""
    rows = works.select(without_blank_lines("code").alias("content"), F.col("filepath").alias("link"), F.lit(extension).alias("extension"), F.lit(repo_name).alias("repo_name"))
    return rows.withColumns(text_lengths("content")).where(F.col("count_lines_without_blank_lines") > min_lines)


def save_corpus(rows: DataFrame, path: str) -> None:
    indexed = rows.select(F.monotonically_increasing_id().alias("_index"), *rows.columns)
    indexed.write.mode("overwrite").option("sep", ";").option("header", True).option("escape", '"').csv(path)


def read_corpus(spark: SparkSession, path: str, max_count_lines: int | None = None) -> DataFrame:
    rows = spark.read.option("sep", ";").option("header", True).option("escape", '"').option("multiLine", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).schema(CORPUS).csv(path).drop("_index")
    return rows if not max_count_lines else rows.where(F.col("count_lines_without_blank_lines") < max_count_lines)


def keep_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with one key, the last by order."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_row"))
    return last.select("_row.*")


def mean_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean_value"))


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of the columns."""
    return df.select(*columns).summary()


def rolling_mean(df: DataFrame, order: str, value: str, size: int = 20, partition: str | None = None) -> DataFrame:
    """Adds rolling_mean over the last ``size`` rows; null until there are as many.

    With a partition each key is a series of its own. Without one the series is a
    single one, which suits the few rows of a survey."""
    w = (Window.partitionBy(partition) if partition else Window.partitionBy()).orderBy(order).rowsBetween(1 - size, 0)
    return df.withColumn("rolling_mean", F.when(F.count(value).over(w) == size, F.avg(value).over(w)))


def linear_trend(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """slope and intercept of the least-squares line, for each key; null without two different x."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))
    wide = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(wide != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / wide)
    return s.select(*keys, slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("intercept"))


def power_trend(df: DataFrame, x: str, y: str, power: int, *keys: str) -> DataFrame:
    """factor of the least-squares fit y = factor * x ** power, for each key."""
    a = F.pow(F.col(x).cast("double"), F.lit(power))
    s = df.groupBy(*keys).agg(F.sum(a * a).alias("_s"), F.sum(a * F.col(y).cast("double")).alias("_t"))
    return s.select(*keys, F.when(F.col("_s") != 0, F.col("_t") / F.col("_s")).alias("factor"))


def trend(df: DataFrame, x: str, y: str, degree: int = 1) -> list[float]:
    """Least-squares polynomial, the highest power first, from sums of powers: one
    pass over the rows, then a small system on the driver."""
    import numpy as np

    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.agg(*[F.sum(F.pow(a, F.lit(k))).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow(a, F.lit(k)) * b).alias(f"t{k}") for k in range(degree + 1)]).first()
    system = np.array([[sums[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    return np.linalg.solve(system, np.array([sums[f"t{i}"] for i in range(degree + 1)]))[::-1].tolist()
