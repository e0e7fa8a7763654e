"""Results between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete the shuffle files of a query once it has ended.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that goes to Python, where the session allows more.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Folders of this process, removed at its end.
_own: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; without it a ``local`` master gets
    one under the machine's temporary directory."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"{tempfile.gettempdir()}/quillmatch-steps-{spark.sparkContext.applicationId}"
    if own not in _own:
        _own.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and read it again; the shuffles that it took are deleted."""
    spark = df.sparkSession
    path = f"{folder(spark)}/quillmatch/{label}-{uuid.uuid4().hex}"
    held = {FREED: "true", BATCH: "8m"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`written` wrote for frames that are no longer read."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/quillmatch/" not in path:
                raise ValueError(f"not a scratch folder: {path}")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
