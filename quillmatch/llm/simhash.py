"""SimHash near-duplicates found with Golay-code fuzzy hashing.

Fingerprints are 64-bit majorities over XXH64 hashes of word shingles. They are
cut into segments of 23, 23 and 18 bits. The binary Golay code (23, 12, 7) is
perfect: each 23-bit word lies within 3 bits of one codeword, and two words at
distance 2 or less share a codeword within 4 bits of both. So the keys of a
segment are the indices of all codewords within 4 bits (one or six). With at
most 4 differing bits in three segments, the two best segments have at most 2
each: two fingerprints that link agree in a pair of keys for one of the three
pairs of segments. Rows meet by such a pair (24 bits) and are verified.

Only distinct fingerprints take part, so exact copies cost one row. Runs of
equal keys are read as a sorted stream; of the verified links a spanning forest
is emitted, never all pairs. A run of more than ``CHUNK`` fingerprints is dealt
in chunks, and each two chunks are compared in a task of their own: no task
holds more than two chunks, and no link is lost.

Defined cases: null text counts as empty; texts without words have fingerprint
zero and link to each other like any others. A null doc_id takes part but is
never a component_id unless the component has no other. Repeated rows appear as
often as they occur. An empty table gives an empty result. Other columns are
not read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

BITS = 64
#: Generator polynomial of the binary Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0xC75
SEGMENTS = ((0, 23), (23, 23), (46, 18))
RADIUS = 4
CHUNK = 4096


def fingerprint(text: str, size: int = 4, seed: int = 42) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(flat, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -size] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(flat[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(x) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "th"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and th, a hash of the text."""
    rows = common.texts(docs).withColumn("th", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"doc_id {kind}, fp long, th long")


class Golay:
    """Codeword indices near 23-bit words, by syndrome."""

    def __init__(self) -> None:
        def rest(x: int) -> int:
            for k in range(22, 10, -1):
                if x >> k & 1:
                    x ^= GENERATOR << (k - 11)
            return x

        one = [rest(1 << k) for k in range(23)]
        self.part = [np.zeros(256, np.int32) for _ in range(3)]
        for i in range(3):
            for b in range(256):
                s = 0
                for k in range(8):
                    if b >> k & 1 and 8 * i + k < 23:
                        s ^= one[8 * i + k]
                self.part[i][b] = s
        near: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(RADIUS + 1):
            for bits in combinations(range(23), weight):
                s = 0
                for k in bits:
                    s ^= one[k]
                near[s].append(sum(1 << k for k in bits))
        self.near = np.full((2048, 6), -1, np.int64)
        for s, found in enumerate(near):
            self.near[s, : len(found)] = found

    def keys(self, words: np.ndarray) -> np.ndarray:
        """n x 6 indices (12 bits) of the codewords within 4 bits, -1 where there are fewer."""
        p = self.part
        errors = self.near[p[0][words & 255] ^ p[1][words >> 8 & 255] ^ p[2][words >> 16]]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def joint_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for all pairs of segments; rows index ``fps`` (uint64)."""
    each = [code.keys((fps >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in SEGMENTS]
    keys, rows = [], []
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        left, right = each[i][:, :, None], each[j][:, None, :]
        both = np.where((left < 0) | (right < 0), -1, k << 24 | left << 12 | right).reshape(len(fps), -1)
        row, col = np.nonzero(both >= 0)
        keys.append(both[row, col])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = Golay()
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(every), 2000):
            fps = every[k : k + 2000]
            keys, rows = joint_keys(fps.view(np.uint64), code)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])


class Forest:
    """Union-find over the rows of a buffer, with the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.up[a] != self.up[b]
        if not new.any():
            return
        for x, y in zip(a[new].tolist(), b[new].tolist()):
            r, s = self.find(x), self.find(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.links.append((x, y))
        while not np.array_equal(flat := self.up[self.up], self.up):
            self.up = flat


def run_links(keys: np.ndarray, fps: np.ndarray, limit: int = 4) -> np.ndarray:
    """Links (pairs of rows) that span all fingerprints within ``limit`` bits in
    each run of equal keys; the rows are sorted by key."""
    forest, at, step = Forest(len(keys)), np.arange(len(keys)), 1
    while len(at := at[at + step < len(keys)]) and len(at := at[keys[at] == keys[at + step]]):
        close = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= limit]
        if len(close):
            forest.add(close, close + step)
        step += 1
    return np.array(forest.links, np.int64).reshape(-1, 2)


def _links(chunk: int, limit: int):
    def out(kind, key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(np.asarray(key, np.int64)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], names=["kind", "key", "a", "b"])

    def settle(keys, fps):
        pairs = run_links(keys, fps.view(np.uint64), limit)
        return out(0, keys[pairs[:, 0]], fps[pairs[:, 0]], fps[pairs[:, 1]])

    def dealt(keys, fps, first):
        """Rows of one long run, with the numbers of their chunks."""
        return out(1, keys, fps, (first + np.arange(len(fps))) // chunk)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        long_key, sent = None, 0
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
            if long_key is not None:
                n = int(np.searchsorted(keys, long_key, "right"))
                yield dealt(keys[:n], fps[:n], sent)
                sent += n
                keys, fps = keys[n:], fps[n:]
                if len(keys):
                    long_key = None
            if not len(keys):
                continue
            runs = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate(([0], runs)), np.concatenate((runs, [len(keys)]))
            last = len(starts) - 1  # the last run may go on in the next batch
            big = np.flatnonzero(ends - starts > chunk)
            small = np.ones(len(keys), bool)
            for r in big:
                yield dealt(keys[starts[r] : ends[r]], fps[starts[r] : ends[r]], 0)
                small[starts[r] : ends[r]] = False
                if r == last:
                    long_key, sent = keys[-1], int(ends[r] - starts[r])
            small[starts[last] :] = False
            yield settle(keys[small], fps[small])
            keep = len(keys) if long_key is not None else starts[last]
            keys, fps = keys[keep:], fps[keep:]
        if len(keys):
            yield settle(keys, fps)

    return work


def _chunk_pair_links(limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        fps = rows.column("fp").to_numpy()
        side = rows.column("chunk").to_numpy()
        a = np.flatnonzero(side == side.min())
        b = np.flatnonzero(side == side.max())
        forest = Forest(len(fps))
        bits = fps.view(np.uint64)
        for x in a:
            near = b[np.bitwise_count(bits[b] ^ bits[x]) <= limit]
            if len(near):
                forest.add(np.full(len(near), x), near)
        pairs = np.array(forest.links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(fps[pairs[:, 0]]), pa.array(fps[pairs[:, 1]])], names=["a", "b"])

    return work


def links(nodes: DataFrame, limit: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within ``limit`` bits."""
    if limit > 4:
        raise ValueError("the segments and the code's radius hold for up to 4 bits")
    # Distinct values are few and small, so their partitions are merged into one or
    # two; dealt out evenly again, as each of them becomes 81 keys.
    width = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select("fp").repartition(width).mapInArrow(_emit_keys, "key long, fp long")
    met = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(chunk, limit), "kind int, key long, a long, b long")
    met = common.materialize(met, "links")
    found = met.where("kind = 0").select("a", "b")
    long_runs = met.where("kind = 1").select("key", F.col("a").alias("fp"), F.col("b").alias("chunk"))
    if long_runs.isEmpty():
        return found.distinct()
    chunks = long_runs.groupBy("key").agg(F.max("chunk").alias("last")).withColumnRenamed("key", "k")
    pairs = long_runs.join(chunks, F.col("key") == F.col("k")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    pairs = pairs.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp", "chunk")
    dense = pairs.groupBy("key", "i", "j").applyInArrow(_chunk_pair_arrow(limit), "a long, b long")
    return found.unionByName(dense).distinct()


def _chunk_pair_arrow(limit: int):
    inner = _chunk_pair_links(limit)

    def work(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(inner(iter(rows.to_batches()))))

    return work


def _joined_by(rows: DataFrame, key: str, side: DataFrame, side_key: str) -> DataFrame:
    """rows joined with one row of ``side`` a key. A key may hold a third of the rows:
    the side is written first, so that both inputs of the join come straight from a
    shuffle and adaptive execution can split a partition that one key fills."""
    side = common.materialize(side.withColumnRenamed(side_key, "_key"), "side")
    return rows.join(side.hint("merge"), F.col(key) == F.col("_key")).drop("_key")


def _grouped(docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp and th of all rows; root, node: the component's smallest fingerprint
    for each fingerprint, also for those without links)."""
    rows = common.materialize(fingerprints(docs), "fingerprints")
    nodes = common.materialize(rows.select("fp").distinct(), "nodes")
    root = graph.components(links(nodes, limit)).select(F.col("node").alias("n"), "root")
    every = nodes.join(root, F.col("fp") == F.col("n"), "left").select(F.col("fp").alias("node"), F.coalesce("root", "fp").alias("root"))
    return rows, common.materialize(every, "roots")


def _first_of(rows: DataFrame, roots: DataFrame, value) -> DataFrame:
    """node and first, the smallest value of its component: per fingerprint first, so
    that copies are summed up where they lie and a component's rows are its fingerprints."""
    each = rows.groupBy(F.col("fp").alias("f")).agg(F.min(value).alias("v")).join(roots, F.col("f") == F.col("node"))
    least = each.groupBy(F.col("root").alias("r")).agg(F.min("v").alias("first"))
    # Roots are hot where a component has many fingerprints; the least is one row each.
    return _joined_by(roots, "root", least, "r").select("node", "first")


def clusters(docs: DataFrame, limit: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id that links reach."""
    rows, roots = _grouped(docs, limit)
    first = _first_of(rows, roots, F.col("doc_id"))
    return _joined_by(rows, "fp", first, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id")
    )


def keep_one(docs: DataFrame, limit: int = 4) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the
    smallest doc_id (then text hash) stays, once; a row without doc_id only where
    the component has no other."""
    rows, roots = _grouped(docs, limit)
    # A struct's minimum puts nulls first, so whether doc_id is null stands before it.
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")
    first = _first_of(rows, roots, order).select(F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th")).distinct()
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(first.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(first["_id"]) & (text == first["_th"]), "left_semi")
    if rows.count() != rows.select("doc_id", "th").distinct().count():
        th = common.fresh(docs, "_th")
        kept = kept.withColumn(th, F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", th]).drop(th)
    return kept


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(common.table(spark, sf_dir, "documents"))
