"""The check of a set of works: from sources to stored results."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, extract, pairs
from ..schema import DEFAULT_MAX_DEPTH, DEFAULT_NGRAMS, DEFAULT_THRESHOLD, DEFAULT_WEIGHTS, EXTENSIONS, MODES, ExitCode
from ..sources import files as local
from ..sources import github
from ..sources.store import Store, split_cached_pairs, split_cached_works, upsert_csv


@dataclass
class Outcome:
    """What a check found: new results, valid cached ones, and the exit code."""

    found: DataFrame
    cached: DataFrame | None
    exit_code: int

    def shown(self, short_output: int = 0) -> DataFrame | None:
        """Results to display: 0 all, 1 new ones, 2 none."""
        if short_output == 2:
            return None
        return self.found if short_output == 1 or self.cached is None else self.found.unionByName(self.cached)


def exit_code(found: Column) -> Column:
    """The exit code of many results: that of a find if there is any (an aggregate)."""
    return F.coalesce(F.bit_or(F.when(found, int(ExitCode.FOUND_SIMILAR)).otherwise(int(ExitCode.SUCCESS))), F.lit(int(ExitCode.SUCCESS)))


class WorksComparator:
    def __init__(
        self, spark: SparkSession, extension: str, mode: str = "many_to_many", threshold: int | None = DEFAULT_THRESHOLD, ngrams_length: int = DEFAULT_NGRAMS,
        max_depth: int = DEFAULT_MAX_DEPTH, path_regexp: str | None = None, repo_regexp: str | None = None, all_branches: bool = False, token: str = "",
        features: Store | None = None, results: Store | None = None, csv_report: str | None = None, weights: Sequence[float] = DEFAULT_WEIGHTS,
        flush_pairs: int = 1_000_000,
    ) -> None:
        if extension not in EXTENSIONS and extension != "html":
            raise ValueError(f"unknown extension '{extension}'")
        if mode not in MODES:
            raise ValueError(f"the mode must be one of {MODES}")
        self.spark, self.extension, self.mode, self.threshold, self.n = spark, extension, mode, threshold, ngrams_length
        self.max_depth, self.path_regexp, self.repo_regexp, self.all_branches, self.token = max_depth, path_regexp, repo_regexp, all_branches, token
        self.features, self.results, self.csv_report, self.weights, self.flush_pairs = features, results, csv_report, weights, flush_pairs

    def works(self, files: Sequence[str] = (), directories: Sequence[str] = (), github_user: str = "", github_urls: Sequence[str] = ()) -> DataFrame | None:
        """All works; each directory, URL and repository is a collection, all files are one."""
        parts = []
        if files:
            parts.append(local.works_from_files(self.spark, [str(f) for f in files], self.extension))
        if directories:
            parts.append(local.works_from_directories(self.spark, [str(d) for d in directories], self.extension, self.path_regexp))
        if github_user or github_urls:
            self.spark.dataSource.register(github.HostSource)
            reader = self.spark.read.format("code_host").option("extension", self.extension).option("allBranches", str(self.all_branches).lower())
            for name, value in (("token", self.token), ("user", github_user), ("urls", ",".join(github_urls)), ("repoRegexp", self.repo_regexp), ("pathRegexp", self.path_regexp)):
                reader = reader.option(name, value) if value else reader
            parts.append(reader.load())
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def extract(self, works: DataFrame) -> DataFrame:
        """Feature rows, from the cache where path and date agree; new ones go to the cache."""
        if self.features is None:
            return extract.features_from_works(works, self.extension).persist()
        hits, misses = split_cached_works(works, self.features.read())
        new = extract.features_from_works(misses, self.extension).persist()
        every = hits.unionByName(new).persist()
        every.count()
        if not new.isEmpty():
            self.features.upsert(new)
        return every

    def compare(self, features: DataFrame) -> Outcome:
        """Compare all pairs, batch by batch: what a batch finds is stored before the
        next one begins, so a run that dies loses one batch at most, and the next
        run takes the rest up from there."""
        candidates = pairs.scored_candidates(features, self.threshold, self.n, self.mode, self.weights)
        cached = None
        if self.results is not None:
            cached, candidates = split_cached_pairs(candidates, features, self.results.read())
            cached = cached.persist()
        batches = 1
        if self.results is not None or self.csv_report:
            candidates = candidates.persist()
            batches = max(1, -(-candidates.count() // self.flush_pairs))
        code = exit_code(F.lit(True))
        found, codes = None, cached.agg(code).first()[0] if cached is not None else int(ExitCode.SUCCESS)
        for k in range(batches):
            some = candidates if batches == 1 else candidates.where(F.pmod(F.xxhash64("first", "second"), F.lit(batches)) == k)
            part = compare.compare_pairs(some, features, self.threshold, self.n, self.max_depth, self.weights).persist()
            new = part.agg(code).first()[0]
            if new and self.results is not None:
                self.results.upsert(part)
            if new and self.csv_report:
                upsert_csv(self.spark, self.csv_report, part)
            found, codes = part if found is None else found.unionByName(part), codes | new
        return Outcome(found, cached, codes)

    def check(self, files: Sequence[str] = (), directories: Sequence[str] = (), github_user: str = "", github_urls: Sequence[str] = ()) -> Outcome | None:
        """Compare all works of the sources; None if there are no sources."""
        works = self.works(files, directories, github_user, github_urls)
        return None if works is None else self.compare(self.extract(works))


def compare_works(spark: SparkSession, first: str, second: str, extension: str = "py", threshold: int | None = None, n: int = DEFAULT_NGRAMS, max_depth: int = DEFAULT_MAX_DEPTH, weights=DEFAULT_WEIGHTS) -> DataFrame:
    """compare_info of two sources given as text, without a row if they stay under the threshold."""
    works = spark.createDataFrame([("first", first, "", "a"), ("second", second, "", "b")], "filepath string, code string, modify_date string, collection_id string")
    features = extract.features_from_works(works, extension)
    pair = spark.createDataFrame([("first", "second")], "first string, second string")
    return compare.compare_pairs(pair, features, threshold, n, max_depth, weights)


def pairwise_matrix(features: DataFrame, n: int = DEFAULT_NGRAMS) -> DataFrame:
    """The Jaccard coefficients of all works with all, a row a work and a column each."""
    found = compare.with_sides(pairs.all_pairs(features), features, ("tokens",))
    j = found.select("first", "second", compare.grams.jaccard(F.col("a.tokens"), F.col("b.tokens"), n).alias("j"))
    both = j.unionByName(j.select(F.col("second").alias("first"), F.col("first").alias("second"), "j"))
    return both.groupBy("first").pivot("second").agg(F.first("j")).orderBy("first")


def access_token(environment: str | None = None) -> str:
    """ACCESS_TOKEN of an environment file, else of the environment."""
    if environment and os.path.exists(environment):
        with open(environment) as f:
            for line in f:
                if m := re.match(r"\s*(?:export\s+)?ACCESS_TOKEN\s*=\s*[\"']?([^\"'\s]*)", line):
                    return m[1]
    return os.environ.get("ACCESS_TOKEN", "")
