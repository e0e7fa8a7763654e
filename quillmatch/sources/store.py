"""Stores of features and results: keyed upserts, caches, CSV reports.

A store is a sequence of Parquet folders; of the rows with one key that of the
last folder counts. An upsert writes its rows as a further folder and commits a
version file that lists all folders, by a rename that fails if the version is
there already. A writer that lost such a race commits again on top of the one
that won, so no writer's rows are lost. Many folders are merged into one now and
then. Folders that no recent version lists are deleted only after
``KEEP_SECONDS``: frames that still read them, and tasks that read them anew
after the loss of an executor, find them in their place.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import list_text, matrix_text, parse_list_text, parse_matrix_text
from ..schema import COMPARE_INFO, CSV_COLUMNS, FEATURES

RESULT_KEY = ("first_path", "second_path")
FEATURES_KEY = ("filepath",)


def upserted(old: DataFrame, new: DataFrame, key) -> DataFrame:
    """Old rows whose key is not among the new ones, and the new rows."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


#: How long folders stay that the last version does not list.
KEEP_SECONDS = 7 * 86_400.0
#: Folders of a version, at most, before they are merged.
MOST_FOLDERS = 16


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key) -> None:
        self.spark, self.path, self.schema, self.key = spark, str(path).rstrip("/"), schema, tuple(key)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(conf)
        root = self._fs.makeQualified(self._Path(self.path))
        self._context, self._root = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf), root.toString()

    def _names(self, folder: str) -> list[str]:
        path = self._Path(f"{self._root}/{folder}")
        return sorted(f.getPath().getName() for f in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _current(self) -> tuple[int, list[str]]:
        """The last version (0: none) and its folders, the oldest first."""
        known = [n for n in self._names("versions") if n.startswith("v")]
        if not known:
            return 0, []
        path = self._Path(f"{self._root}/versions/{known[-1]}")
        size = self._fs.getFileStatus(path).getLen()
        stream = self._fs.open(path)
        body = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
        stream.close()
        return int(known[-1][1:]), body.decode().split()

    def _commit(self, version: int, folders: list[str]) -> bool:
        """Make a version visible; False if another writer has made it first."""
        made, final = self._Path(f"{self._root}/versions/.{uuid.uuid4().hex}"), self._Path(f"{self._root}/versions/v{version:09d}")
        stream = self._fs.create(made, False)
        stream.write(bytearray("\n".join(folders).encode()))
        stream.close()
        plain = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(made, final, plain)
        except Exception:
            self._fs.delete(made, False)
            if not self._fs.exists(final):
                raise
            return False
        return True

    def _rows(self, folders: list[str]) -> DataFrame:
        read = self.spark.read.schema(self.schema)
        if len(folders) < 2:
            return read.parquet(f"{self._root}/data/{folders[0]}") if folders else self.spark.createDataFrame([], self.schema)
        every = None
        for age, folder in enumerate(folders):
            part = read.parquet(f"{self._root}/data/{folder}").select(F.lit(age).alias("_age"), F.struct(*self.schema.names).alias("_row"))
            every = part if every is None else every.unionByName(part)
        # Keys are compared as they are: a null key is a key.
        last = every.groupBy(*[F.col(f"_row.{k}") for k in self.key]).agg(F.max_by("_row", "_age").alias("_row"))
        return last.select("_row.*")

    def read(self) -> DataFrame:
        return self._rows(self._current()[1])

    def upsert(self, rows: DataFrame) -> None:
        folder = uuid.uuid4().hex
        rows.select(*self.schema.names).dropDuplicates(list(self.key)).write.parquet(f"{self._root}/data/{folder}")
        while True:
            version, folders = self._current()
            if self._commit(version + 1, [*folders, folder]):
                break
        if len(folders) >= MOST_FOLDERS:
            self.merge()

    def merge(self) -> None:
        """One folder instead of those of the current version; later upserts stay on top."""
        _, old = self._current()
        folder = uuid.uuid4().hex
        self._rows(old).write.parquet(f"{self._root}/data/{folder}")
        while True:
            version, folders = self._current()
            if folders[: len(old)] != old:  # another writer merged first
                return
            if self._commit(version + 1, [folder, *folders[len(old) :]]):
                return self.vacuum()

    def vacuum(self, keep_seconds: float = KEEP_SECONDS) -> None:
        """Delete old folders that the last version does not list, and old version files."""
        before = (time.time() - keep_seconds) * 1000
        old = {d: [f.getPath() for f in self._fs.listStatus(self._Path(f"{self._root}/{d}")) if f.getModificationTime() < before] for d in ("data", "versions")}
        version, folders = self._current()  # after the listing, so that no new commit is missed
        for d, used in (("data", set(folders)), ("versions", {f"v{version:09d}"})):
            for path in old[d]:
                if path.getName() not in used:
                    self._fs.delete(path, True)

    def clear(self) -> None:
        self._fs.delete(self._Path(self._root), True)


def result_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, COMPARE_INFO, RESULT_KEY)


def feature_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, FEATURES, FEATURES_KEY)


# Caches


def split_cached_works(works: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature rows that are still valid, works to be parsed): a hit has the work's path and date."""
    key = ["filepath", "modify_date"]
    hits = cached.join(works.select(*key, F.col("collection_id").alias("_c")).distinct(), key).withColumn("collection_id", F.col("_c")).select(*cached.columns)
    return hits, works.join(cached.select(*key), key, "left_anti").select(*works.columns)


def split_cached_pairs(pairs: DataFrame, features: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results that are still valid, pairs to be compared): hashes and heads of both works must agree."""
    side = lambda p: features.select(F.col("filepath").alias(f"{p}_path"), F.col("sha256").alias(f"_{p}_sha"), F.col("head_nodes").alias(f"_{p}_heads"))
    found = cached.join(pairs.select(F.col("first").alias("first_path"), F.col("second").alias("second_path")), list(RESULT_KEY)).join(side("first"), "first_path").join(side("second"), "second_path")
    for p in ("first", "second"):
        found = found.where((F.col(f"{p}_sha256") == F.col(f"_{p}_sha")) & (F.col(f"{p}_heads") == F.col(f"_{p}_heads")))
    hits = found.select(*cached.columns)
    keys = hits.select(F.col("first_path").alias("first"), F.col("second_path").alias("second"))
    return hits, pairs.join(keys, ["first", "second"], "left_anti")


# CSV reports


def to_csv_rows(results: DataFrame) -> DataFrame:
    """Results as the flat columns of a CSV report, all strings."""
    flat = {
        "first_heads": list_text("first_heads"), "second_heads": list_text("second_heads"), "struct_similarity": F.col("structure.similarity"),
        "compliance_matrix": matrix_text("structure.compliance_matrix"), **{c: F.col(f"fast.{c}") for c in ("jakkar", "operators", "keywords", "literals", "weighted_average")},
    }
    return results.select(*[(flat[c] if c in flat else F.col(c)).cast("string").alias(c) for c in CSV_COLUMNS])


def from_csv_rows(rows: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).cast("double")
    return rows.select(
        "date", *[x for p in ("first", "second") for x in (f"{p}_path", f"{p}_modify_date", f"{p}_sha256", parse_list_text(f"{p}_heads").alias(f"{p}_heads"))],
        F.struct(*[number(c).alias(c) for c in ("jakkar", "operators", "keywords", "literals", "weighted_average")]).alias("fast"),
        F.struct(number("struct_similarity").alias("similarity"), parse_matrix_text("compliance_matrix").alias("compliance_matrix")).alias("structure"),
    )


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Results of a CSV report: semicolons, an index column first, all columns strings."""
    schema = StructType().add("_index", "string")
    for c in CSV_COLUMNS:
        schema = schema.add(c, "string")
    rows = spark.read.option("sep", ";").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).schema(schema).csv(str(path))
    rows = rows.fillna("", ["first_modify_date", "second_modify_date"])
    return from_csv_rows(rows.drop("_index"))


def write_csv(results: DataFrame, path: str) -> None:
    """Replace a CSV report: one file, written beside it and renamed over it.

    A report is for people, so it is small; the results themselves belong in a store."""
    import os

    rows = to_csv_rows(results).orderBy("first_path", "second_path").toPandas()
    temporary = f"{path}.{uuid.uuid4().hex}"
    rows.to_csv(temporary, sep=";")
    os.replace(temporary, path)


def upsert_csv(spark: SparkSession, path: str, results: DataFrame) -> None:
    import os

    new = results if not os.path.exists(path) else upserted(read_csv(spark, path), results, RESULT_KEY)
    write_csv(new, path)
