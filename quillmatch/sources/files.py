"""Works from files and folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import decode_udf
from ..schema import EXTENSIONS


def _contents(spark: SparkSession, paths: Sequence[str], recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(list(paths))


def plain_path(path):
    """A local file's path without its scheme; other paths as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def _works(files: DataFrame, extension: str, collection) -> DataFrame:
    """Empty and unreadable files drop out here."""
    rows = files.where("length > 0").select(
        plain_path(F.col("path")).alias("filepath"), decode_udf(extension)("content").alias("code"),
        F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss").alias("modify_date"), collection.alias("collection_id"),
    )
    return rows.where("code is not null")


def accepts(path, extension: str | None = None, path_regexp: str | None = None):
    """The condition on a path: one of the extension's patterns, and the expression anywhere in it."""
    patterns = EXTENSIONS[extension] if extension else (r"\..*$",)
    name = F.regexp_extract(path, "([^/]*)$", 1)
    ok = F.lit(False)
    for p in patterns:
        ok = ok | name.rlike(p)
    return ok if path_regexp is None else ok & path.rlike(path_regexp)


def works_from_files(spark: SparkSession, files: Sequence[str], extension: str) -> DataFrame:
    """The files as they are named, without any filter; one collection."""
    return _works(_contents(spark, files, False), extension, F.lit("files"))


def works_from_directory(spark: SparkSession, directory: str, extension: str, path_regexp: str | None = None) -> DataFrame:
    files = _contents(spark, [directory], True)
    return _works(files.where(accepts(plain_path(F.col("path")), extension, path_regexp)), extension, F.lit(str(directory)))


def works_from_directories(spark: SparkSession, directories: Sequence[str], extension: str, path_regexp: str | None = None) -> DataFrame | None:
    """Each directory is a collection of its own."""
    out = None
    for d in directories:
        part = works_from_directory(spark, d, extension, path_regexp)
        out = part if out is None else out.unionByName(part)
    return out
