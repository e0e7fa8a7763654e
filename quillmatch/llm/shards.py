"""A store of immutable shards with size-tiered compaction and versioned manifests.

``append`` writes arrivals as small Parquet shards and commits a manifest that
lists them. ``compact`` groups shards of similar size (the same power of
``fan_in``), in order of arrival, into merges of about ``target`` bytes; each
merge is one task that streams its shards into one new file, without a shuffle.
Old shards are never changed: the new manifest names the merged files instead.

A manifest becomes visible by one rename that fails if the version exists, so
two writers can't both commit a version, and a job that dies leaves the last
version as it was. A writer that loses the race applies its change to the
version that won. Readers see exactly the files of one version. ``vacuum``
deletes files that the last versions don't name and that are older than
``min_age_s``, so that it leaves arrivals alone which are being written.

Only manifests (a line per shard) are held by the driver.

Defined cases: rows are kept as they are, with nulls, repeated rows, empty and
very long texts and all columns, whatever they are called: ``placed`` gives its
number a free name. Appending an empty table commits a version without new
shards; reading an empty store needs the schema that was given. Shards of equal
size keep their order of arrival.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from math import floor, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common


@dataclass(frozen=True)
class Options:
    target: int = 64 << 20
    fan_in: int = 4
    #: Rows of an arrival's shards, at most.
    arrival_rows: int = 2000
    #: Merges that are planned into one Spark job.
    merges_per_job: int = 64
    #: Times that a change is applied anew after another writer's commit.
    retries: int = 20
    #: Manifests with more shards are joined by a shuffle instead of a broadcast.
    broadcast_shards: int = 200_000


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


class Conflict(RuntimeError):
    """Another writer committed this version first."""


def plan(shards: list[Shard], options: Options = Options()) -> list[list[Shard]]:
    """The merges of one round: shards of one tier, in order, up to the target.

    A merge needs ``fan_in`` shards, or as many as fill three quarters of the
    target. Shards of half the target or more are left alone.
    """
    tiers: dict[int, list[Shard]] = defaultdict(list)
    for s in shards:
        if s.size < options.target / 2:
            tiers[floor(log(max(s.size, 1), options.fan_in))].append(s)
    merges = []
    for tier in sorted(tiers):
        group: list[Shard] = []
        for s in [*tiers[tier], None]:
            total = sum(x.size for x in group)
            if group and (s is None or total + s.size > options.target):
                if len(group) >= options.fan_in or (len(group) > 1 and total >= 0.75 * options.target):
                    merges.append(group)
                group = []
            if s is not None:
                group.append(s)
    return merges


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: StructType) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._Path(self.path).getFileSystem(conf)
        root = self._fs.makeQualified(self._Path(self.path))
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        self._root = root.toString()
        self._fs.mkdirs(self._Path(f"{self._root}/manifests"))

    # Manifests

    def versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._Path(f"{self._root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """(version, shards); the last version unless one is named. Version 0 is empty."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return 0, []
        path = self._Path(f"{self._root}/manifests/v{version:012d}.json")
        size = self._fs.getFileStatus(path).getLen()
        stream = self._fs.open(path)
        data = self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)
        stream.close()
        return version, [Shard(f"{self._root}/{s['path']}", s["size"]) for s in json.loads(bytes(data))["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Make ``base + 1`` visible, or raise :class:`Conflict`."""
        version = base + 1
        cut = len(self._root) + 1
        body = json.dumps({"version": version, "shards": [asdict(s) | {"path": s.path[cut:]} for s in shards]}).encode()
        temporary = self._Path(f"{self._root}/manifests/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(body))
        stream.close()
        final = self._Path(f"{self._root}/manifests/v{version:012d}.json")
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(temporary, final, none)
        except Exception as e:
            self._fs.delete(temporary, False)
            if self._fs.exists(final):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    # Data

    def _listed(self, folder: str) -> list[Shard]:
        files = [f for f in self._fs.listStatus(self._Path(folder)) if f.getPath().getName().endswith(".parquet")]
        return sorted((Shard(f.getPath().toString(), f.getLen()) for f in files), key=lambda s: s.path)

    def append(self, rows: DataFrame, options: Options = Options()) -> int:
        """Write arrivals as small shards and commit them."""
        folder = f"{self._root}/data/{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", options.arrival_rows).parquet(folder)
        new = self._listed(folder)
        return self._change(lambda shards: shards + new, options)

    def _change(self, change, options: Options) -> int:
        """Commit ``change`` of the last version's shards, again if another writer came first."""
        for _ in range(options.retries):
            base, shards = self.manifest()
            try:
                return self.commit(base, change(shards))
            except Conflict:
                continue
        raise Conflict(f"{options.retries} commits of other writers came first")

    def _frame(self, shards: list[Shard]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[s.path for s in shards])

    @contextmanager
    def _separate_union(self):
        """A union of one-partition inputs keeps a partition for each of them;
        Spark 4.1 would put them all into one."""
        name = "spark.sql.unionOutputPartitioning"
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "false")
        try:
            yield
        finally:
            self.spark.conf.unset(name) if before is None else self.spark.conf.set(name, before)

    def compact(self, options: Options = Options()) -> int:
        """Merge until no tier is due; one commit. Returns the version."""
        base, shards = self.manifest()
        gone: dict[Shard, Shard | None] = {}  # what stands for a merged shard
        while merges := plan(shards, options):
            for k in range(0, len(merges), options.merges_per_job):
                some = merges[k : k + options.merges_per_job]
                out = None
                for group in some:  # one task and one file each, in this order
                    part = self._frame(group).coalesce(1)
                    out = part if out is None else out.union(part)
                folder = f"{self._root}/data/{uuid.uuid4().hex}"
                with self._separate_union():
                    out.write.parquet(folder)
                made = self._listed(folder)
                if len(made) != len(some):
                    raise RuntimeError("a merge did not write one file")
                for group, new in zip(some, made):
                    gone |= dict.fromkeys(group) | {group[0]: new}
            shards = _replaced(shards, gone)
        if not gone:
            return base

        def change(now: list[Shard]) -> list[Shard]:
            if missing := {s for s in first if s in gone} - set(now):
                raise RuntimeError(f"another writer merged {len(missing)} of these shards")
            return _replaced(now, gone)

        first = self.manifest(base)[1]
        return self._change(change, options)

    def read(self, version: int | None = None) -> DataFrame:
        _, shards = self.manifest(version)
        return self._frame(shards) if shards else self.spark.createDataFrame([], self.schema)

    def vacuum(self, keep: int = 1, min_age_s: float = 86_400) -> None:
        """Delete data files that none of the last ``keep`` versions names, of
        folders that nothing was written to for ``min_age_s`` seconds."""
        data = self._Path(f"{self._root}/data")
        before = (time.time() - min_age_s) * 1000
        old = [f for f in self._fs.listStatus(data) if f.getModificationTime() <= before] if self._fs.exists(data) else []
        # Read after the listing: what was committed meanwhile is in use.
        used = {s.path for v in self.versions()[-keep:] for s in self.manifest(v)[1]}
        for folder in old:
            files = self._listed(folder.getPath().toString())
            if not any(f.path in used for f in files):
                self._fs.delete(folder.getPath(), True)
            else:
                for f in files:
                    if f.path not in used:
                        self._fs.delete(self._Path(f.path), False)


def _replaced(shards: list[Shard], gone: dict[Shard, Shard | None]) -> list[Shard]:
    """The shards with those that were merged left out, and the merged file in the
    place of its first one; merged files may have been merged again."""
    out = []
    for s in shards:
        while s is not None and s in gone:
            s = gone[s]
        if s is not None:
            out.append(s)
    return out


def _file_of(path: str) -> str:
    """Folder and name of a file: unique in a store."""
    return "/".join(path.rsplit("/", 2)[-2:])


def placed(store: Store, version: int | None = None, name: str = "shard", columns: dict | None = None, options: Options = Options()) -> DataFrame:
    """The rows of a version (or ``columns`` made of them) with the number of the
    file that holds them, under ``name`` or the next free name.

    The number comes from the manifest by a join on the file's name, which is
    broadcast while the manifest is small; rows are never shuffled then."""
    _, shards = store.manifest(version)
    rows = store.read(version)
    file, key = common.fresh(rows, "_file_of"), common.fresh(rows, "_file")
    place = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1) if shards else F.lit("")
    rows = rows.select(*([F.col(f"`{c}`") for c in rows.columns] if columns is None else [c.alias(n) for n, c in columns.items()]), place.alias(file))
    name = common.fresh(rows, name)
    numbers = store.spark.createDataFrame([(_file_of(s.path), i) for i, s in enumerate(shards)], f"{key} string, {name} long")
    if len(shards) <= options.broadcast_shards:
        numbers = F.broadcast(numbers)
    return rows.join(numbers, F.col(file) == F.col(key)).drop(file, key)


ARRIVALS = 4


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard and a hash of the whole row, read back after the table came in
    several arrivals (by a hash of doc_id) and was compacted."""
    docs = common.table(spark, sf_dir, "documents")
    store = Store(spark, common.scratch_path(spark, "shards"), docs.schema)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    for k in range(ARRIVALS):
        store.append(docs.where(part == k))
    store.compact()
    store.vacuum(min_age_s=0)  # no one else writes to this store
    return placed(store, columns={"doc_id": F.col("doc_id"), "row_hash": F.xxhash64(*docs.columns)}).select("doc_id", "shard", "row_hash")
