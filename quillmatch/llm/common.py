"""Helpers shared by the training-data operators.

Nothing here is imported by the rest of the library.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of this process, removed at its end.
_own: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a single-machine master (``local`` or ``local[n]``) may go without the
    setting; it then gets a folder under the machine's temporary directory.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"{tempfile.gettempdir()}/quillmatch-{spark.sparkContext.applicationId}"
    if own not in _own:
        _own.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/quillmatch/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage the way ``checkpoint()`` does, but in a columnar file that
    later reads can prune, and that survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for frames that are no longer read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in frames:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if "/quillmatch/" not in folder:
                raise ValueError(f"not a scratch folder: {folder}")
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all scratch data in the shared folder, once no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillmatch")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null becomes empty) and the further columns named."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
