"""Pairs of works by their shared n-grams, in compact arrays: an exact inverted
index whose shuffles carry bytes instead of rows.

Works and grams are known by hashes of 64 and 56 bits. Four steps deal them out:

1. Every gram goes to a range of hashes. A gram of a single work ends there;
   all others go back to their works with a class of how many works have them.
2. A work orders its grams by class, the rarest first. A pair at the least
   coefficient must meet among the first ``n - ceil(least * n) + 1``, so only those
   of them that are shared go on to meet the same grams of other works.
3. Where two works meet at a gram, what is left in either bounds what they can
   have in common. Of the meetings that leave at least ``m`` the pairs' numbers are
   summed; a pair that needs ``need`` common grams has at least ``need - m + 1`` of them.
4. Remaining pairs are dealt to places, those of a group of near copies to one. The
   shared grams of their works travel there, once to each, and are counted.

Results between the steps are written, and the shuffles that they took deleted, so that
the disk holds those of one step at a time.

All bounds are exact: no pair at the least coefficient is left out. Rows with one
path are one work, whose grams are taken once.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written

SLACK = 1e-9
#: Bytes of a gram, a step from id to id, numbers and a class, and how many of them are kept as they are.
KEY, ID, COUNT, CLASS, RANK = (7, 6), (8, 5), (4, 0), (1, 0), (4, 1)
KEY_BITS = 8 * KEY[0]
#: Grams of works that a task deals out at a time.
SLICE = 2_000_000
#: Meetings that leave this part of the grams that a pair needs are counted.
LEFT = 0.9
#: Pairs made at a time.
MEETINGS = 500_000
#: Bytes of rows that Python sends at a time.
BATCH = 4_000_000
#: Pairs of a place that are counted together.
BLOCK = 50_000

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

POSTINGS = "bucket long, ids binary, counts binary, keys binary, more binary"


def _release() -> None:
    """Memory of earlier batches back to the machine: a worker lives on and would keep it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _packed(x: np.ndarray, n_bytes: int, raw: int) -> bytes:
    """Bytes of equal weight together; those above the lowest ``raw`` by Huffman codes."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:n_bytes])
    coder = zlib.compressobj(1, zlib.DEFLATED, 15, 8, zlib.Z_HUFFMAN_ONLY)
    return planes[:raw].tobytes() + coder.compress(planes[raw:].tobytes()) + coder.flush() + len(x).to_bytes(4, "little")


def _unpacked(data: bytes, n_bytes: int, raw: int) -> np.ndarray:
    n = int.from_bytes(data[-4:], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :raw] = np.frombuffer(data, np.uint8, n * raw).reshape(raw, n).T
    out[:, raw:n_bytes] = np.frombuffer(zlib.decompress(data[n * raw : -4]), np.uint8).reshape(n_bytes - raw, n).T
    return out.view("<u8").ravel()


def _range(x: np.ndarray, bits: int, n_buckets: int) -> np.ndarray:
    """Which of equal ranges of ``bits``-bit numbers each is in."""
    return ((x >> np.uint64(bits - 32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def _steps(ids: np.ndarray) -> bytes:
    """Ids in ascending order."""
    return _packed(np.diff(ids, prepend=ids.dtype.type(0)), *ID)


def _joined(arrays: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays]).astype(kind, copy=False)


def _ids(rows: pa.Table) -> np.ndarray:
    return _joined([np.cumsum(_unpacked(x, *ID), dtype=np.uint64) for x in rows.column("ids").to_pylist()], np.uint64)


def _column(rows: pa.Table, name: str, layout: tuple[int, int], kind) -> np.ndarray:
    return _joined([_unpacked(x, *layout).astype(kind) for x in rows.column(name).to_pylist() if x is not None], kind)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    made = lambda some: pa.table({name: pa.array([r[k] for r in some], kinds[kind]) for k, (name, kind) in enumerate(fields)})
    # A batch for every few megabytes: the JVM holds one of them at a time.
    sizes = np.cumsum([sum(len(x) for x in r if isinstance(x, bytes)) for r in rows])
    cuts = [0, *(np.flatnonzero(np.diff(sizes // BATCH)) + 1).tolist(), len(rows)] if rows else [0, 0]
    return pa.concat_tables([made(rows[a:b]) for a, b in zip(cuts, cuts[1:])])


def _blobs(bucket: np.ndarray, owner: np.ndarray, ids: np.ndarray, keys: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """A row for each bucket; postings are in order of bucket, then owner (a place in ids, which ascend)."""
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
        mine = owner[a:b]
        starts = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        counts = np.diff(starts, append=len(mine))
        yield int(bucket[a]), _steps(ids[mine[starts]]), _packed(counts, *COUNT), _packed(keys[a:b], *KEY), *[x[a:b] for x in more]


def _dealt(n_buckets: int):
    """Of works (id, grams): their grams by range of hash, and how many each has."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        for batch in batches:
            _, first = np.unique(batch.column(0).to_numpy().view(np.uint64), return_index=True)
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            first = first[sizes[first] > 0]
            for some in np.split(first, np.flatnonzero(np.diff(np.cumsum(sizes[first]) // SLICE)) + 1):
                if len(some):
                    part = batch.take(pa.array(some))
                    yield part.column(0).to_numpy().view(np.uint64), sizes[some], part.column(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, grams in slices(batches):
            keys = pc.list_flatten(grams).to_numpy().view(np.uint64) >> np.uint64(64 - KEY_BITS)
            bucket = _range(keys, KEY_BITS, n_buckets)
            order = np.argsort(bucket.astype(np.uint16) if n_buckets < 1 << 16 else bucket, kind="stable")
            owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
            rows = [(*row, None) for row in _blobs(bucket[order], owner[order], ids, keys[order])]
            rows.append((int(_range(ids[:1], 64, n_buckets)[0]), _steps(ids), _packed(sizes, *COUNT), None, None))
            del keys, bucket, order, owner
            yield from _table(rows, POSTINGS).to_batches()
            del rows
            _release()

    return work


def _postings(rows: pa.Table):
    """(ids in order, without repeats; by list of grams its number of them and place
    among the ids; the keys of all lists)."""
    _release()
    ids, place = np.unique(_ids(rows), return_inverse=True)
    return ids, _column(rows, "counts", COUNT, np.int64), place.astype(np.int32), _column(rows, "keys", KEY, np.uint64)


def _sizes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(id, number of grams) of the works that the rows without keys tell of."""
    rows = rows.filter(pc.is_null(rows.column("keys")))
    return _ids(rows), _column(rows, "counts", COUNT, np.int64)


def _lists(rows: pa.Table) -> pa.Table:
    return rows.filter(pc.is_valid(rows.column("keys")))


def _class(df: np.ndarray) -> np.ndarray:
    """How frequent a gram is, in one byte that grows with the number of its works."""
    return np.where(df <= 128, df, np.minimum(255, 128 + 6 * np.log2(np.maximum(df, 128) / 128))).astype(np.uint8)


def _shared(n_buckets: int):
    """The grams of a range that two works or more have, back to ranges of works."""

    def work(rows: pa.Table) -> pa.Table:
        ids, counts, place, keys = _postings(_lists(rows))
        out = []
        # A work that was met by several tasks counts once.
        fresh = np.zeros(len(place), bool)
        fresh[np.unique(place, return_index=True)[1]] = True
        keep = np.repeat(fresh, counts)
        owner, keys = np.repeat(place, counts)[keep], keys[keep]
        order = np.argsort(keys, kind="stable")
        owner, keys = owner[order], keys[order]
        del order, keep
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        df = np.diff(starts, append=len(keys))
        often = np.repeat(_class(df), df)
        keep = np.flatnonzero(np.repeat(df > 1, df))
        keep = keep[np.argsort(owner[keep], kind="stable")]
        owner, keys, often = owner[keep], keys[keep], often[keep]
        for row in _blobs(_range(ids, 64, n_buckets)[owner], owner, ids, keys, often):
            out.append((*row[:-1], _packed(row[-1], *CLASS)))
        every, n = _sizes(rows)
        bucket = _range(every, 64, n_buckets)
        order = np.argsort(bucket, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            some = some[np.argsort(every[some], kind="stable")]
            out.append((int(bucket[some[0]]), _steps(every[some]), _packed(n[some], *COUNT), None, None))
        return _table(out, POSTINGS)

    return work


def _sets(rows: pa.Table):
    """(ids, n of each, and its shared grams in their order: owner, key, rank among all n)."""
    lists = _lists(rows)
    ids, counts, place, keys = _postings(lists)
    owner, often = np.repeat(place, counts), _column(lists, "more", CLASS, np.uint8)
    every, n = _sizes(rows)
    every, first = np.unique(every, return_index=True)
    n = n[first][np.searchsorted(every, ids)]
    order = np.lexsort((keys, owner.astype(np.int64) << 8 | often))
    owner, keys = owner[order], keys[order]
    have = np.bincount(owner, minlength=len(ids))
    rank = np.arange(1, len(owner) + 1) + np.repeat(n - have - (np.cumsum(have) - have), have)
    return ids, n, owner, keys, rank


def _least(n: np.ndarray, least: float) -> np.ndarray:
    return np.ceil(n * least - SLACK).astype(np.int64)


def _prefixes(n_buckets: int, least: float):
    """Of each work the shared grams that a partner must meet, by range of hash."""

    def work(rows: pa.Table) -> pa.Table:
        ids, n, owner, keys, rank = _sets(rows)
        keep = np.flatnonzero(rank <= (n - _least(n, least) + 1)[owner])
        bucket = _range(keys, KEY_BITS, n_buckets)
        keep = keep[np.lexsort((owner[keep], bucket[keep]))]
        out = []
        for row in _blobs(bucket[keep], owner[keep], ids, keys[keep], rank[keep], n[owner[keep]]):
            out.append((*row[:4], _packed(np.concatenate([row[4], row[5]]), *RANK)))
        return _table(out, POSTINGS)

    return work


MET = "a long, b long, n long, least long"


def _met(least: float):
    """Pairs that meet at the grams of a range: how often, and how often they must in all."""

    def work(rows: pa.Table) -> pa.Table:
        ids, counts, place, keys = _postings(rows)
        owner = np.repeat(place.astype(np.int64), counts)
        more = [_unpacked(x, *RANK).reshape(2, -1) for x in rows.column("more").to_pylist()]
        rank, n = (_joined([x[k] for x in more], np.int64) for k in (0, 1))
        size = np.zeros(len(ids), np.int64)
        size[owner] = n
        del more, place, counts
        # In a gram's run by size: partners of a work lie in a window of sizes.
        order = np.lexsort((owner, n, keys))
        owner, keys, rank, n = owner[order], keys[order], rank[order], n[order]
        run = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        # Each posting meets those behind it, up to 1 / least times its size.
        width = int(n.max()) + 2 if len(n) else 1
        wide = np.minimum(np.floor(n / least + SLACK), width - 1).astype(np.int64)
        upto = np.searchsorted(run * width + n, run * width + wide, "right")
        follow = upto - np.arange(len(keys)) - 1
        del order, run, wide, upto
        total, begin = np.concatenate(([0], np.cumsum(follow))), 0
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        found: list[np.ndarray] = []

        def needs(n_x: np.ndarray, n_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """How many grams two works must share, and m."""
            need = _least((n_x + n_y) * 1.0, least / (1 + least))
            return need, np.maximum(np.ceil(LEFT * need).astype(np.int64), _least(np.maximum(n_x, n_y), least))

        def folded() -> None:
            nonlocal pairs, times
            some, number = np.unique(_joined(found, np.int64), return_counts=True)
            found.clear()
            merged = np.union1d(pairs, some)
            numbers = np.zeros(len(merged), np.int64)
            numbers[np.searchsorted(merged, pairs)] = times
            numbers[np.searchsorted(merged, some)] += number
            pairs, times = merged, numbers

        while begin < len(keys):
            stop = max(begin + 1, int(np.searchsorted(total, total[begin] + MEETINGS, "right")) - 1)
            each = follow[begin:stop]
            x = np.repeat(np.arange(begin, stop), each)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(each) - each, each)
            ok = 1 + np.minimum(n[x] - rank[x], n[y] - rank[y]) >= needs(n[x], n[y])[1]
            x, y = owner[x[ok]], owner[y[ok]]
            found.append(np.minimum(x, y) * len(ids) + np.maximum(x, y))
            if sum(map(len, found)) > 4 * MEETINGS:
                folded()
            begin = stop
        folded()
        x, y = pairs // max(len(ids), 1), pairs % max(len(ids), 1)
        out = []
        for k in range(0, max(len(x), 1), MEETINGS):
            i, j = x[k : k + MEETINGS], y[k : k + MEETINGS]
            need, m = needs(size[i], size[j])
            out.append(pa.table({"a": pa.array(ids[i].view(np.int64)), "b": pa.array(ids[j].view(np.int64)), "n": pa.array(times[k : k + MEETINGS]), "least": pa.array(np.maximum(need - m + 1, 1))}))
        return pa.concat_tables(out)

    return work


def _placed(pairs: DataFrame, n_buckets: int) -> DataFrame:
    """(a, b, bucket): where each pair is counted. Works that belong together meet in one
    place, named by the least work that either of a pair is paired with, so that a group
    of near copies travels there once; the pairs of a large place are dealt out in blocks."""
    ends = pairs.select(F.col("a").alias("v"), F.col("b").alias("u")).union(pairs.select("b", "a"))
    least = ends.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("u", "v").alias("u"))
    side = lambda k: least.select(F.col("v").alias(k), F.col("u").alias(f"u_{k}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.least("u_a", "u_b").alias("place"))
    large = found.groupBy("place").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK)
    large = large.select(F.col("place").alias("large"), F.ceil(F.sqrt(2 * F.col("k") / BLOCK)).alias("k"))
    found = found.join(F.broadcast(large), F.col("place") == F.col("large"), "left")
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.coalesce("k", F.lit(1)))
    block = (F.least(part("a"), part("b")), F.greatest(part("a"), part("b")))
    return found.select("a", "b", F.pmod(F.xxhash64("place", *block), F.lit(n_buckets)).cast("long").alias("bucket"))


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs of ``sizes`` from ``starts``, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _sent(rows: pa.Table, wanted: pa.Table) -> pa.Table:
    """The shared grams of works to the places of their pairs, with the number of all their grams."""
    if not wanted.num_rows:
        return _table([], POSTINGS)
    ids, counts, place, keys = _postings(_lists(rows))
    every, n = _sizes(rows)
    every, first = np.unique(every, return_index=True)
    n = n[first][np.searchsorted(every, ids)]
    owner = np.repeat(place, counts)
    keys = keys[np.argsort(owner, kind="stable")]
    have = np.bincount(owner, minlength=len(ids))
    begin = np.cumsum(have) - have
    del owner, every, first, place, counts
    bucket, which = wanted.column("bucket").to_numpy(), np.searchsorted(ids, wanted.column("id").to_numpy().view(np.uint64))
    order = np.lexsort((which, bucket))
    out = []
    for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        k = which[some]
        out.append((int(bucket[some[0]]), _steps(ids[k]), _packed(have[k], *COUNT), _packed(keys[_flat(begin[k], have[k])], *KEY), _packed(n[k], *COUNT)))
    return _table(out, POSTINGS)


COUNTED = "a long, b long, n_common long, n_a long, n_b long"


def _counted(rows: pa.Table, pairs: pa.Table) -> pa.Table:
    """Grams that the pairs of a place have in common."""
    _release()
    ids, have, n = _ids(rows), _column(rows, "counts", COUNT, np.int64), _column(rows, "more", COUNT, np.int64)
    some, keys = np.unique(_column(rows, "keys", KEY, np.uint64), return_inverse=True)
    keys, begin, marked = keys.astype(np.int32), np.cumsum(have) - have, np.zeros(len(some), bool)
    del some
    order = np.argsort(ids)
    a, b = (order[np.searchsorted(ids[order], pairs.column(c).to_numpy().view(np.uint64))] for c in ("a", "b"))
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    common = np.zeros(len(a), np.int64)
    # Pairs of one first work, and no more than SLICE grams of their second ones at a time.
    large = (np.cumsum(have[b]) // SLICE) if len(b) else b
    cuts = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(large, prepend=0) != 0))
    for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)]):
        mine = keys[begin[a[x]] : begin[a[x]] + have[a[x]]]
        marked[mine] = True
        sizes = have[b[x:y]]
        met = np.concatenate(([0], np.cumsum(marked[keys[_flat(begin[b[x:y]], sizes)]])))
        upto = np.cumsum(sizes)
        common[x:y] = met[upto] - met[upto - sizes]
        marked[mine] = False
    longs = (ids[a].view(np.int64), ids[b].view(np.int64), common, n[a], n[b])
    return pa.table([pa.array(x) for x in longs], names=[x.split()[0] for x in COUNTED.split(", ")])


def overlaps(works: DataFrame, least: float) -> DataFrame:
    """(a, b, n_common, n_a, n_b) of all pairs of works (id long, grams array<long>
    without repeats) whose Jaccard coefficient is at least ``least`` > 0. What a step
    yields is written to the shared folder, and what it took is deleted."""
    n = int(works.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    homes = 2 * n  # ranges of works, and of places
    # Every range of grams tells of its works anew: half as many, so that this costs less.
    dealt = works.mapInArrow(_dealt(max(1, n // 2)), POSTINGS)
    shared = written(dealt.groupBy("bucket").applyInArrow(_shared(homes), POSTINGS), "grams")
    # As few ranges here as their grams allow, as a pair may meet in each of them.
    size = (shared.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) / KEY[0]
    ranges = max(1, min(n // 2, round((1 - least) * size / SLICE)))
    prefixes = shared.groupBy("bucket").applyInArrow(_prefixes(ranges, least), POSTINGS)
    met = prefixes.groupBy("bucket").applyInArrow(_met(least), MET)
    enough = met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("least").alias("least")).where("n >= least").select("a", "b")
    found = written(enough, "pairs")
    placed = written(_placed(found, homes), "placed")
    wanted = placed.select(F.col("a").alias("id"), "bucket").union(placed.select("b", "bucket")).distinct()
    top = F.shiftrightunsigned("id", 32)
    wanted = wanted.withColumn("home", F.shiftrightunsigned(top * homes, 32))
    sent = shared.groupBy("bucket").cogroup(wanted.groupBy("home")).applyInArrow(_sent, POSTINGS)
    counted = sent.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(_counted, COUNTED)
    j = F.col("n_common") / (F.col("n_a") + F.col("n_b") - F.col("n_common"))
    out = written(counted.where(j >= least - SLACK), "counted")
    discard(shared, found, placed)
    return out
