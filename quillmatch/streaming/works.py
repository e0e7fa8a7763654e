"""Continuous checks of a folder of works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, extract, pairs
from ..operators.extract import decode_udf
from ..schema import DEFAULT_NGRAMS, DEFAULT_THRESHOLD
from ..sources.files import accepts, plain_path
from ..sources.store import Store

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_works(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """A stream of the works that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").load(folder)
    chosen = files.where(accepts(plain_path(F.col("path")), extension if extension in ("py", "cpp") else None))
    rows = chosen.select(plain_path(F.col("path")).alias("filepath"), decode_udf(extension)("content").alias("code"), F.date_format("modificationTime", "yyyy-MM-dd HH:mm:ss").alias("modify_date"), F.lit(folder).alias("collection_id"))
    return rows.where("code is not null")


def check_batch(works: DataFrame, extension: str, features: Store, results: Store, threshold: int = DEFAULT_THRESHOLD, n: int = DEFAULT_NGRAMS) -> None:
    """Compare the new works with each other and with all known ones, and store both."""
    new = extract.features_from_works(works, extension).persist()
    if new.isEmpty():
        return
    fresh = new.select(F.col("filepath").alias("_new"))
    every = features.read().join(fresh, F.col("filepath") == F.col("_new"), "left_anti").unionByName(new)
    found = pairs.scored_candidates(every, threshold, n)
    # Two equi-joins instead of one on either side, which would be a nested loop.
    one, other = (found.join(fresh, F.col(side) == F.col("_new"), "left_semi") for side in ("first", "second"))
    touched = one.unionByName(other).distinct()
    # Results first: works whose features are stored already would not be compared again.
    results.upsert(compare.compare_pairs(touched, every, threshold, n))
    features.upsert(new)
    new.unpersist()


def start(spark: SparkSession, folder: str, extension: str, features: Store, results: Store, checkpoint: str, threshold: int = DEFAULT_THRESHOLD, interval: str = "60 seconds", once: bool = False):
    """Start the stream; ``once`` handles what is there and ends."""
    writer = stream_works(spark, folder, extension).writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: check_batch(df, extension, features, results, threshold))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
