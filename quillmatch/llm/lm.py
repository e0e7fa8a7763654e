"""Language-model scores by online logistic context mixing.

A text is its lower-cased words, each closed by a space, and one end. Each of its
UTF-8 bytes is a walk down a fixed binary tree (frequent bytes near the root), and
each step is a bit to be predicted. Six predictors give each bit a probability
from hashed contexts that run across words: the last one, two, four and six bytes,
the word so far, and the word so far with the word before it. A predictor's slot
holds how often the bit was 0 and 1 in all training texts. The predictions are
mixed in the logistic domain by weights that a gate selects (place of the bit in
its byte, and how many of the three longest contexts have been seen); an
adaptive map then refines the mixed probability. Weights and map are learned in
``rounds`` of steps, each over further training texts, so that every one of them is
learned from in one step; the bit at hand is left out of the counts there.

Above the bits stands a predictor of whole passages. Texts are cut into chunks
at words chosen by their hash (16 words on average, 64 at most), so equal
passages give equal chunks wherever they stand. Where the chunk before has a
known successor in another training document, one bit says whether it follows
again; its probability mixes the counts of successors with the hits so far in
the text. A chunk that follows costs that bit alone; any other is coded bit by
bit. Successions are counted over the whole corpus and grow with it.

The score is the sum of the logarithms of all these bits: nothing else decides.

How it is distributed: tasks of about ``task_chars`` characters fill tables of a fixed size
(as a context mixer's memory is), which are summed block by block; tables, map
and weights (10 MB) are broadcast. One pass then spells every text and turns a
part of ``part_chars`` into lists of words and chunks. Word counts and
successions are summed by key and joined back to the parts: words that make up a
``1 / frequent`` of the tokens by broadcast (at most ``frequent`` words), all
others by a shuffle, where a key then has few rows. No text is shuffled.

Defined cases: null text counts as empty (its only token is the end). A null
doc_id counts as training. Very long texts are spelled in windows of ``window``
bytes whose contexts reach back ``overlap`` bytes. Repeated rows are trained
on and scored as often as they occur, and vouch for each other. Without training
tokens every probability is 1/2 and the base score is 0. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from . import common

END = "\n"
#: The frequent bytes, the most frequent first.
LISTED = " etaoinshrdlcumwfgypbvkxjqz\n.,0123456789;:!?'\"()-_/@#$%&*+".encode() + b"\xc3"
#: Places of a bit that have weights of their own; deeper bits share the last one's.
PLACES = 8
ORDERS = (1, 2, 4, 6)
PREDICTORS = len(ORDERS) + 2
#: Zero bytes before each text: more than the longest order.
PAD = 8
GATES = 4
STEPS = 64
CHUNK_EVERY, CHUNK_MOST = 16, 64


@dataclass(frozen=True)
class Options:
    held_out_of: int = 7
    held_out_is: int = 2
    part_chars: int = 8_000_000
    #: Characters of the training texts that a task turns into tables, about.
    task_chars: int = 64_000_000
    #: Slots of each hashed predictor, as a power of two: the model's memory.
    table_bits: int = 20
    #: Bytes worked on at a time, and how far a window of a long text looks back.
    window: int = 1 << 16
    overlap: int = 4096
    #: Steps of learning; each training document is in one of them.
    rounds: int = 4
    #: Words of at least this part of the tokens are joined by broadcast.
    frequent: int = 500_000


# --- symbols and contexts --------------------------------------------------------------------------------------------

def _tree() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The binary tree of all bytes (Huffman's, over weights by rank): by depth and
    byte the number of the node on its way, and the bit there; each byte's depth."""
    rank = {b: k for k, b in enumerate(LISTED)}
    weight = [40_000 // (rank[b] + 2) if b in rank else 80 if 0x80 <= b < 0xC0 else 5 for b in range(256)]
    heap = [(w, b, b) for b, w in enumerate(weight)]
    heapq.heapify(heap)
    made: list[tuple] = []
    while len(heap) > 1:
        (w, _, left), (x, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        made.append((left, right))
        heapq.heappush(heap, (w + x, 255 + len(made), 255 + len(made)))
    ways: list[list[tuple[int, int]]] = [[] for _ in range(256)]

    def walk(node: int, way: list[tuple[int, int]]) -> None:
        if node < 256:
            ways[node] = way
            return
        for bit, child in enumerate(made[node - 256]):
            walk(child, [*way, (node - 256, bit)])

    walk(heap[0][2], [])
    depth = max(map(len, ways))
    nodes, bits = np.zeros((depth, 256), np.uint8), np.zeros((depth, 256), np.uint8)
    for b, way in enumerate(ways):
        for k, (node, bit) in enumerate(way):
            nodes[k, b], bits[k, b] = node, bit
    return nodes, bits, np.array([len(w) for w in ways], np.uint8)


NODES, PLACE_BITS, DEPTHS = _tree()
_DEEPEST = len(NODES)
#: Spread of the tree's nodes, added to hashed contexts.
_NODE = np.array([(0x9E3779B1 * (k * k + 3 * k + 1) ^ 0x7F4A7C15 * k) & 0xFFFFFFFF for k in range(256)], np.uint32)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWER = 0x9E3779B97F4A7C15


class Stream:
    """The bytes of texts one after the other, PAD zeros before each."""

    def __init__(self, texts: pa.Array) -> None:
        trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
        self.lists = pc.ascii_split_whitespace(trimmed)
        joined = pc.binary_join(self.lists, " ")
        joined = pc.if_else(pc.equal(joined, ""), END, pc.binary_join_element_wise(joined, END, " ")).cast(pa.large_string())
        n = len(joined)
        offsets = np.frombuffer(joined.buffers()[1], np.int64, n + 1, joined.offset * 8)
        raw = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
        self.n_bytes = np.diff(offsets)
        #: Where each text's bytes end.
        self.ends = np.cumsum(self.n_bytes + PAD)
        #: Which symbols are of texts, not the zeros before them.
        self.of_text = np.ones(len(raw) + n * PAD, bool)
        for k in range(PAD):
            self.of_text[self.ends - self.n_bytes - PAD + k] = False
        self.symbols = np.zeros(len(self.of_text), np.uint8)
        self.symbols[self.of_text] = raw
        #: Last byte of each token (word or end).
        self.token_ends = np.flatnonzero((self.symbols == 32) | (self.symbols == 10))

    def windows(self, options: Options) -> Iterator[tuple[int, int, int]]:
        """(begin, end, where contexts begin): whole texts up to a window, long texts alone in windows."""
        begin = 0
        starts = np.concatenate(([0], self.ends))
        k = 0
        while k < len(self.ends):
            stop = max(k + 1, int(np.searchsorted(starts, begin + options.window, "right")) - 1)
            end = int(starts[stop])
            if end - begin <= options.window:
                yield begin, end, begin
            else:
                for a in range(begin, end, options.window):
                    yield a, min(end, a + options.window), max(begin, a - options.overlap)
            begin, k = end, stop


def contexts(symbols: np.ndarray, power: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """For each byte the hashed contexts of all predictors (uint32, a row each; that of order 1 is exact)."""
    n = len(symbols)
    wide = np.zeros(n + PAD, np.uint32)
    wide[PAD:] = symbols
    back = [wide[PAD - k : PAD - k + n] for k in range(1, max(ORDERS) + 1)]
    one = back[0]
    two = one | back[1] << 8
    four = two | back[2] << 16 | back[3] << 24
    six = four * np.uint32(0x85EBCA77) + (back[4] | back[5] << 8) * np.uint32(0xC2B2AE3D) + np.uint32(1)
    # Hash of the word so far, from sums of powers; a word begins after a space, an end or zeros.
    value = symbols.astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((value + np.uint64(1)) * power[:n], out=sums[1:])
    at = np.arange(n, dtype=np.int64)
    begins = at.copy()
    begins[(one > 32) & (at > 0)] = 0
    start = np.maximum.accumulate(begins)
    word = (sums[:-1] - sums[start]) * inverse[start]
    before = word[np.maximum(start - 1, 0)]
    before[start == 0] = 0
    word = (word + np.uint64(77)) * _MIX
    both = (word ^ (before + np.uint64(5)) * np.uint64(_POWER)) * _MIX
    high = np.uint64(32)
    out = np.empty((PREDICTORS, n), np.uint32)
    out[0] = one
    out[1] = (two + np.uint32(1)) * np.uint32(0x9E3779B1)
    out[2] = (four ^ four >> np.uint32(15)) * np.uint32(0x9E3779B1)
    out[3] = (six ^ six >> np.uint32(15)) * np.uint32(0x9E3779B1)
    out[4] = word >> high
    out[5] = both >> high
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a fixed odd number and of its inverse, modulo 2**64."""
    out = []
    for base in (_POWER, pow(_POWER, -1, 1 << 64)):
        x = np.full(max(n, 1), base, np.uint64)
        x[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(x))
    return out[0], out[1]


def layout(table_bits: int) -> tuple[list[int], list[int]]:
    """(bits of each predictor's table, where each begins, and the end of all)."""
    bits = [16, *[table_bits] * (PREDICTORS - 1)]
    return bits, [0, *np.cumsum([1 << b for b in bits]).tolist()]


#: By depth and byte: the node on the byte's way, its spread, and the bit there.
_WAY, _SPREAD, _BIT = NODES.astype(np.uint32), _NODE[NODES], PLACE_BITS.astype(np.float32)
_DEPTHS = DEPTHS.astype(np.intp)


def slots(bases: np.ndarray, symbols: np.ndarray, depth: int, options: Options, bit_size: int = 0) -> np.ndarray:
    """The slots (of all tables in a row) that the predictors ask about the bits of
    symbols at a depth; with ``bit_size``, as many further on where the bit is 1."""
    out = np.empty(bases.shape, np.uint32)
    np.left_shift(bases[0], np.uint32(8), out=out[0])
    out[0] |= _WAY[depth].take(symbols, mode="clip")
    np.add(bases[1:], _SPREAD[depth].take(symbols, mode="clip"), out=out[1:])
    out[1:] >>= np.uint32(32 - options.table_bits)
    out[1:] += np.array(layout(options.table_bits)[1][1:-1], np.uint32)[:, None]
    if bit_size:
        out += (_WAY.dtype.type(bit_size) * PLACE_BITS[depth].astype(np.uint32)).take(symbols, mode="clip")
    return out.astype(np.intp)


def _known(options: Options) -> tuple[np.ndarray, np.ndarray]:
    return powers(options.window + options.overlap)


def _cut(stream: Stream, options: Options, known):
    """(symbols, contexts, which symbols are of texts, begin) of each window."""
    for begin, end, reach in stream.windows(options):
        bases = contexts(stream.symbols[reach:end], *known)
        yield stream.symbols[begin:end], bases[:, begin - reach :], stream.of_text[begin:end], begin


# --- tables ----------------------------------------------------------------------------------------------------------

BLOCK = 1 << 16
#: Bits worked on at a time, so that they stay in a core's cache.
MANY = 1 << 14


def count_bits(tables: np.ndarray, texts: pa.Array, options: Options, known) -> None:
    """Add the bits of the texts to tables (slots x 2: how often each was 0 and 1)."""
    _, begins = layout(options.table_bits)
    stream = Stream(texts)
    every = [np.empty(int(stream.n_bytes.sum()), np.uint64) for _ in range(PREDICTORS)]
    at = 0
    for symbols, bases, of_text, _ in _cut(stream, options, known):
        there = np.flatnonzero(of_text)
        for k, own in enumerate(every):
            np.left_shift(bases[k].take(there), np.uint64(8), out=own[at : at + len(there)])
            own[at : at + len(there)] |= symbols.take(there)
        at += len(there)
    for k in range(PREDICTORS):
        # Equal contexts with equal symbols once, with their number.
        keys, every[k] = every[k], None
        keys = keys[:at]
        keys.sort()
        first = np.flatnonzero(np.concatenate((keys[1:] != keys[:-1], [True]))) if at else np.zeros(0, np.int64)
        times = np.diff(first, prepend=-1).astype(np.int32)
        keys = keys.take(first)
        order = np.argsort(np.uint8(_DEEPEST) - DEPTHS.take(keys.astype(np.uint8)), kind="stable")
        keys, times = keys.take(order), times.take(order)
        base, symbols = (keys >> np.uint64(8)).astype(np.uint32), keys.astype(np.uint8).astype(np.intp)
        deeper = len(keys) - np.cumsum(np.bincount(_DEPTHS.take(symbols), minlength=_DEEPEST + 1))
        flat = tables[begins[k] : begins[k + 1]].reshape(-1)
        for d in range(_DEEPEST):
            for a in range(0, int(deeper[d]), MANY):
                here = slice(a, min(a + MANY, int(deeper[d])))
                some = symbols[here]
                event = base[here] << np.uint32(8) | _WAY[d].take(some) if k < 1 else base[here] + _SPREAD[d].take(some) >> np.uint32(32 - options.table_bits)
                np.add.at(flat, (event << np.uint32(1) | PLACE_BITS[d].take(some)).astype(np.intp), times[here])


def _count(options: Options):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = layout(options.table_bits)[1][-1]
        tables, known, any_ = np.zeros((total, 2), np.int32), _known(options), False
        for texts in _slices(batches, options.part_chars // 8, 0):
            count_bits(tables, texts.column(0), options, known)
            any_ = True
        for k in range(0, total if any_ else 0, BLOCK):
            part = tables[k : k + BLOCK]
            if part.any():
                packed = zlib.compress(part.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int64()), pa.array([packed], pa.binary())], names=["block", "counts"])

    return work


def paired(counts: np.ndarray) -> np.ndarray:
    """Counts of 0 and 1 as two bytes: scaled to 255 at most, and never to zero."""
    most = np.maximum(counts.max(axis=1, keepdims=True), 255)
    small = np.where(counts > 0, np.maximum(counts * 255 // most, 1), 0)
    return (small[:, 0] | small[:, 1] << 8).astype(np.uint16)


def _pair_block(rows: pa.Table) -> pa.Table:
    total = 0
    for x in rows.column("counts"):
        total = total + np.frombuffer(zlib.decompress(x.as_py()), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1, 2).astype(np.int64)
    return pa.table({"block": rows.column("block").slice(0, 1), "pairs": pa.array([paired(total).astype("<u2").tobytes()], pa.binary())})


def _slices(batches: Iterator[pa.RecordBatch], chars: int, column: int) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut to about so many characters of a column; a text is never cut."""
    held, now, size = [], 0, 0
    for whole in batches:
        sizes = pc.binary_length(whole.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        of = (size + np.cumsum(sizes)) // chars
        size += int(sizes.sum())
        cuts = (np.flatnonzero(np.diff(of)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, whole.num_rows]):
            if b > a:
                if held and of[a] != now:
                    yield _joined(held)
                now = int(of[a])
                held.append(whole.slice(a, b - a))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch of those held, which are let go."""
    out = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held.clear()
    pa.default_memory_pool().release_unused()  # a worker lives on and would keep it
    return out


# --- mixing ----------------------------------------------------------------------------------------------------------

_n0, _n1 = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
UNIT = 16
#: From a slot's pair of counts to its stretched prediction, in sixteenths.
_STRETCH = np.round(UNIT * np.log((_n1 + 0.4) / (_n0 + 0.4))).astype(np.int8)
_SEEN = (np.arange(1 << 16) > 0).astype(np.uint8)
#: The pair without one 0, or without one 1.
_WITHOUT = np.stack([np.arange(1 << 16) - (_n0 > 0), np.arange(1 << 16) - ((_n1 > 0) << 8)]).astype(np.uint16)
#: Weights have four digits, so that whole numbers of this part add up to the same in any order.
DIGITS = 10_000


@contextmanager
def _frugal(spark: SparkSession):
    """Small batches between JVM and Python, and shuffles deleted once their step has ended."""
    held = {scratch.FREED: "true", scratch.BATCH: "4m"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Model:
    """Tables (pairs of counts), and by gate and place of a bit: weights of the
    predictors, and a probability for each step of the mixed prediction."""

    def __init__(self, pairs: np.ndarray, weights: np.ndarray, table: np.ndarray) -> None:
        self.pairs, self.weights, self.map = pairs, weights, table

    def tables(self, alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions, and whether a slot was seen; with ``alone`` without
        one 0, and behind these without one 1."""
        if not hasattr(self, "_tables"):
            self._tables = {}
        if alone not in self._tables:
            ways = _WITHOUT if alone else np.arange(1 << 16, dtype=np.uint16)[None]
            self._tables[alone] = tuple(np.concatenate([f[way].take(self.pairs) for way in ways]) for f in (_STRETCH, _SEEN))
        return self._tables[alone]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}


def _squash(x):
    return 1 / (1 + np.exp(-x))


def first_model(pairs: np.ndarray) -> Model:
    centre = (np.arange(STEPS) + 0.5) / 4 - 8
    return Model(pairs, np.full((GATES, PLACES, PREDICTORS), 0.3, np.float32), np.tile(_squash(centre), (GATES, PLACES, 1)).astype(np.float32))


def gated(model: Model, symbols: np.ndarray, bases: np.ndarray, of_text: np.ndarray, options: Options, alone: bool = False):
    """(gate, places, bytes, contexts, how many go deeper than each depth) of the bytes
    whose gate is open: as many of the three longest contexts have been seen (with
    ``alone``, apart from here). Bytes deep in the tree come first, and zeros before texts nowhere."""
    _, begins = layout(options.table_bits)
    known = model.tables(alone)[1]
    longest = slice(PREDICTORS - GATES + 1, PREDICTORS)
    # All ways begin at one node.
    first = (bases[longest] + _SPREAD[0, 0] >> np.uint32(32 - options.table_bits)) + np.array(begins[longest], np.uint32)[:, None]
    if alone:
        first += (np.uint32(begins[-1]) * PLACE_BITS[0].astype(np.uint32)).take(symbols)
    seen = known.take(first.astype(np.intp), mode="clip").sum(axis=0, dtype=np.uint8)
    key = seen * np.uint8(_DEEPEST + 1) + (np.uint8(_DEEPEST) - DEPTHS).take(symbols)
    key[~of_text] = 255
    order = np.argsort(key, kind="stable")[: np.count_nonzero(of_text)]
    every, sorted_bases = symbols.take(order).astype(np.intp), bases.take(order, axis=1)
    of = np.bincount(key, minlength=256)[: GATES * (_DEEPEST + 1)].reshape(GATES, -1)[:, ::-1]
    begin = 0
    for g in range(GATES):
        end = begin + int(of[g].sum())
        if end > begin:
            yield g, order[begin:end], every[begin:end], sorted_bases[:, begin:end], end - begin - np.cumsum(of[g])
        begin = end


def bits(model: Model, symbols: np.ndarray, bases: np.ndarray, of_text: np.ndarray, options: Options, alone: bool = False):
    """(gate, where, depth, place, first, symbols, predictions, mixed prediction) of the bits of a window, some at a time."""
    table, size = model.tables(alone)[0], len(model.pairs)
    whole = np.rint(model.weights.astype(np.float64) * DIGITS).astype(np.float32)
    for g, at, every, base, deeper in gated(model, symbols, bases, of_text, options, alone):
        for d in range(_DEEPEST):
            place = min(d, PLACES - 1)
            for a in range(0, int(deeper[d]), MANY):
                some = every[a : min(a + MANY, int(deeper[d]))]
                x = table.take(slots(base[:, a : a + len(some)], some, d, options, size * alone), mode="clip").astype(np.float32)
                mixed = whole[g, place] @ x
                mixed *= np.float32(1 / (UNIT * DIGITS))
                np.minimum(np.maximum(mixed, np.float32(-7.99), out=mixed), np.float32(7.99), out=mixed)
                yield g, at, d, place, a, some, x, mixed


def _step(mixed: np.ndarray) -> np.ndarray:
    return ((mixed + np.float32(8)) * np.float32(4)).astype(np.intp)


def spell(model: Model, stream: Stream, options: Options, known) -> np.ndarray:
    """log10 probability of each byte of the stream (0 for the zeros before texts)."""
    out = np.zeros(len(stream.symbols), np.float32)
    zero = (1 - _BIT) * np.float32(2)
    for symbols, bases, of_text, begin in _cut(stream, options, known):
        # Two products, as one of many small numbers could leave the range of floats.
        totals = np.ones((2, len(symbols)), np.float32)
        for g, at, d, place, a, some, _, mixed in bits(model, symbols, bases, of_text, options):
            p = model.map[g, place].take(_step(mixed), mode="clip")
            np.negative(mixed, out=mixed)
            np.exp(mixed, out=mixed)
            mixed += np.float32(1)
            p += np.reciprocal(mixed, out=mixed)
            p -= zero[d].take(some, mode="clip")
            np.abs(p, out=p)  # twice the probability of the bit
            p *= np.float32(0.5)
            totals[int(d >= PLACES)][at[a : a + len(some)]] *= p
        out[begin : begin + len(symbols)] = np.log10(totals).sum(axis=0)
    return out


#: Sums of slopes that reach the driver, however many tasks there are.
ADDERS = 16


def slopes(model: Model, texts: pa.Array, options: Options, known) -> np.ndarray:
    """By gate and place of the bit: gradient (P), curvature (P x P), and hits and ones of the map's steps."""
    p_ = PREDICTORS
    out = np.zeros((GATES, PLACES, p_ + p_ * p_ + 2 * STEPS))
    for symbols, bases, of_text, _ in _cut(Stream(texts), options, known):
        for g, _, d, place, _, some, x, mixed in bits(model, symbols, bases, of_text, options, True):
            bit = _BIT[d].take(some, mode="clip")
            p, row = _squash(mixed), out[g, place]
            row[:p_] += x.astype(np.float64) @ (bit - p).astype(np.float64) / UNIT
            curve, heavy = row[p_ : p_ + p_ * p_].reshape(p_, p_), x * (p * (1 - p))
            for k in range(p_):  # products with vectors are faster than one of such flat matrices
                curve[k, : k + 1] += heavy[: k + 1] @ x[k] / UNIT**2
            steps = np.bincount(_step(mixed) + STEPS * bit.astype(np.intp), minlength=2 * STEPS).reshape(2, STEPS)
            row[-2 * STEPS : -STEPS] += steps.sum(axis=0)
            row[-STEPS:] += steps[1]
    curves = out[..., p_ : p_ + p_ * p_].reshape(GATES, PLACES, p_, p_)
    curves += np.tril(curves, -1).swapaxes(-1, -2)
    return out


def _slopes(model, options: Options):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _known(options), 0.0
        for texts in _slices(batches, options.part_chars // 4, 0):
            total = total + slopes(model.value, texts.column(0), options, known)
        if isinstance(total, np.ndarray):
            part = TaskContext.get().partitionId() % ADDERS
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["part", "sums"])

    return work


def _added(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, "<f8") for x in rows.column("sums").to_pylist())
    return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})


def learned(model: Model, sums: np.ndarray, last: bool) -> Model:
    """A damped Newton step of the weights; in the last round the map instead."""
    p_ = PREDICTORS
    weights, table = model.weights.astype(np.float64), model.map.astype(np.float64)
    for g in range(GATES):
        for b in range(PLACES):
            row = sums[g, b]
            if last:
                hits, ones = row[-2 * STEPS : -STEPS], row[-STEPS:]
                table[g, b] = (ones + 20 * table[g, b]) / (hits + 20)
            else:
                curve = row[p_ : p_ + p_ * p_].reshape(p_, p_) + 20 * np.eye(p_)
                weights[g, b] += np.clip(np.linalg.solve(curve, row[:p_]), -0.5, 0.5)
    # Rounded, so that the order of summation does not show.
    return Model(model.pairs, np.round(weights, 4).astype(np.float32), np.round(np.clip(table, 1e-5, 1 - 1e-5), 6).astype(np.float32))


def fit(train: DataFrame, options: Options = Options()) -> Model:
    """The model of the training texts (columns text and pick, a hash of the document)."""
    spark = train.sparkSession
    chars = train.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    _, begins = layout(options.table_bits)
    pairs = np.zeros(begins[-1], np.uint16)
    tasks = max(1, -(-chars // options.task_chars))
    filled = train.select("text").coalesce(tasks).mapInArrow(_count(options), "block long, counts binary")
    for row in filled.groupBy("block").applyInArrow(_pair_block, "block long, pairs binary").collect():
        part = np.frombuffer(row["pairs"], "<u2")
        pairs[row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    model = first_model(pairs)
    for r in range(options.rounds):
        sent = spark.sparkContext.broadcast(model)
        rows = train.where(F.pmod("pick", F.lit(options.rounds)) == r).select("text")
        # One job for all tasks: toLocalIterator() would run them one after the other.
        added = rows.mapInArrow(_slopes(sent, options), "part long, sums binary").groupBy("part").applyInArrow(_added, "sums binary")
        sums = sum((np.frombuffer(x["sums"], "<f8").reshape(GATES, PLACES, -1) for x in added.collect()), 0.0)
        if isinstance(sums, np.ndarray):
            model = learned(model, sums, r == options.rounds - 1)
        sent.unpersist()
    return model


# --- parts: words and chunks -----------------------------------------------------------------------------------------


def part_words(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, word number of each token, text number of each token)."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    words = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    if "" in words:
        keep = index != words.index("")
        index, owner = index[keep], owner[keep]
    return words, index, owner


_CHUNK_POWERS = powers(CHUNK_MOST)[0]


def chunks(hashes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the last token of each chunk, hash of each chunk) from the tokens'
    hashes and whether a token ends its text."""
    n = len(hashes)
    at = np.arange(n, dtype=np.int64)
    cut = last | (hashes % np.uint64(CHUNK_EVERY) == 0)
    after = np.zeros(n, np.int64)
    after[1:] = np.where(cut[:-1], at[1:], 0)
    cut |= (at - np.maximum.accumulate(after)) % CHUNK_MOST == CHUNK_MOST - 1
    ends = np.flatnonzero(cut)
    starts = np.concatenate(([0], ends[:-1] + 1)) if n else ends
    inside = at - np.repeat(starts, ends - starts + 1)
    sums = np.add.reduceat(hashes * _CHUNK_POWERS[inside], starts) if n else np.zeros(0, np.uint64)
    sums = sums * _MIX
    return ends, (sums ^ sums >> np.uint64(31)).view(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


_LONGS = ("n_tokens", "n_bytes", "n_distinct", "n_chunks")
PART_SCHEMA = "part long, word string, lid long, n long, doc_ids array<{}>, held array<boolean>, " + ", ".join(f"{c} array<long>" for c in _LONGS) + ", ids binary, counts binary, chunks binary, spelled binary"


def _parts(model, options: Options, kind: pa.DataType):
    longs = pa.list_(pa.int64())
    kinds = {
        "part": pa.int64(), "word": pa.string(), "lid": pa.int64(), "n": pa.int64(), "doc_ids": pa.list_(kind), "held": pa.list_(pa.bool_()),
        **dict.fromkeys(_LONGS, longs), "ids": pa.binary(), "counts": pa.binary(), "chunks": pa.binary(), "spelled": pa.binary(),
    }

    def batch(size, **have):
        return pa.RecordBatch.from_arrays([have[c] if c in have else pa.nulls(size, k) for c, k in kinds.items()], names=list(kinds))

    def part_rows(rows: pa.RecordBatch, number: int, known):
        held = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
        n_docs = len(held)
        # Spelled a few texts at a time: of a part only words and a cost a token are held.
        lists, n_bytes, costs = [], [], []
        for some in _slices(iter([rows]), options.part_chars // 8, 1):
            stream = Stream(some.column(1))
            lists.append(stream.lists)
            n_bytes.append(stream.n_bytes)
            costs.append(np.add.reduceat(spell(model.value, stream, options, known), np.concatenate(([0], stream.token_ends[:-1] + 1)), dtype=np.float64))
            del stream
        words, index, owner = part_words(pa.concat_arrays(lists))
        n_bytes, costs = np.concatenate(n_bytes), np.concatenate(costs)
        del lists
        size = max(len(words), 1)
        train = np.bincount(index, weights=~held[owner], minlength=len(words)).astype(np.int64)
        used = np.bincount(index, minlength=len(words)) > 0
        both, times = np.unique(owner.astype(np.int64) * size + index, return_counts=True)
        doc, lid = both // size, both % size
        step = np.diff(lid, prepend=0)
        first = np.diff(doc, prepend=-1) > 0
        step[first] = lid[first]
        n_words = np.bincount(owner, minlength=n_docs)
        # Tokens with the end behind each text's words, cut into chunks.
        last = np.zeros(len(index) + n_docs, bool)
        last[np.cumsum(n_words + 1) - 1] = True
        hashed = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
        token = np.full(len(last), xxhash.xxh64_intdigest(END), np.uint64)
        token[~last] = hashed[index]
        ends, found = chunks(token, last)
        text_of = np.repeat(np.arange(n_docs), n_words + 1)[ends]
        cost = np.add.reduceat(costs, np.concatenate(([0], ends[:-1] + 1)))
        one = lambda x, k: pa.array([x], pa.list_(k))
        per = {"n_tokens": n_words + 1, "n_bytes": n_bytes, "n_distinct": np.bincount(doc, minlength=n_docs), "n_chunks": np.bincount(text_of, minlength=n_docs)}
        yield batch(
            1, part=pa.array([number]), doc_ids=one(rows.column(0).to_pylist(), kind), held=one(held, pa.bool_()), **{c: one(x, pa.int64()) for c, x in per.items()},
            ids=pa.array([_planes(step)], pa.binary()), counts=pa.array([_planes(times)], pa.binary()), chunks=pa.array([found.astype("<i8").tobytes()], pa.binary()), spelled=pa.array([cost.astype("<f4").tobytes()], pa.binary()),
        )
        lids = np.flatnonzero(used)
        names_used = pa.array(words, pa.string()).take(pa.array(lids))
        for k in range(0, len(lids), 20_000):
            n = len(lids[k : k + 20_000])
            yield batch(n, part=pa.array(np.full(n, number)), word=names_used.slice(k, n), lid=pa.array(lids[k : k + n]), n=pa.array(train[lids[k : k + n]]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = TaskContext.get().partitionId() << 32, _known(options)
        for rows in _slices(batches, options.part_chars, 1):
            yield from part_rows(rows, number, known)
            number += 1

    return work


def _before(found: np.ndarray, n_chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk before each chunk, 0 for a text's first; text number of each chunk)."""
    owner = np.repeat(np.arange(len(n_chunks)), n_chunks)
    before = np.concatenate(([0], found[:-1])) if len(found) else found
    before[(np.cumsum(n_chunks) - n_chunks)[n_chunks > 0]] = 0
    return before, owner


def _successions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ctx, f, n_train and n_all (documents) of each part's successions of two chunks."""
    for batch in batches:
        for k in range(batch.num_rows):
            n_chunks, held = batch.column(1)[k].values.to_numpy(), batch.column(2)[k].values.to_numpy(zero_copy_only=False)
            found = np.frombuffer(batch.column(3)[k].as_py(), "<i8")
            before, owner = _before(found, n_chunks)
            order = np.lexsort((owner, found, before))
            b, f, o = before[order], found[order], owner[order]
            if not len(b):
                continue
            other = np.concatenate(([True], (b[1:] != b[:-1]) | (f[1:] != f[:-1])))
            fresh = other | np.concatenate(([True], o[1:] != o[:-1]))  # a document counts once
            starts = np.flatnonzero(other)
            n_all = np.add.reduceat(fresh.astype(np.int64), starts)
            n_train = np.add.reduceat((fresh & ~held[o]).astype(np.int64), starts)
            part = pa.array(np.full(len(starts), batch.column(0)[k].as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([part, pa.array(b[starts]), pa.array(f[starts]), pa.array(n_train), pa.array(n_all)], names=["of_part", "ctx", "f", "n_train", "n_all"])


# --- scoring ---------------------------------------------------------------------------------------------------------


def passage_score(found: np.ndarray, spelled: np.ndarray, n_chunks: np.ndarray, held: np.ndarray, ctx: np.ndarray, best: np.ndarray, n_best: np.ndarray, n_all: np.ndarray) -> np.ndarray:
    """log10 probability of each text: bits of succession, and the spelling of all other chunks.

    ctx is sorted; best is its most frequent successor in training documents."""
    before, owner = _before(found, n_chunks)
    at = np.minimum(np.searchsorted(ctx, before), max(len(ctx) - 1, 0))
    known = ctx[at] == before if len(ctx) else np.zeros(len(before), bool)
    pick = lambda x: np.where(known, x[at], 0) if len(ctx) else np.zeros(len(before), np.int64)
    hit = known & (pick(best) == found)
    own = (~held[owner]).astype(np.int64)  # a training document does not vouch for itself
    yes, every = pick(n_best) - own * hit, pick(n_all) - own
    asked = known & (yes > 0)
    hit &= asked
    hits, misses = np.cumsum(hit), np.cumsum(asked & ~hit)
    begin = (np.cumsum(n_chunks) - n_chunks)[owner] if len(owner) else owner
    past = lambda x, now: x - now - np.concatenate(([0], x))[begin]
    h, m = past(hits, hit), past(misses, asked & ~hit)
    counts, history = np.log((yes + 0.4) / (np.maximum(every - yes, 0) + 0.4)), np.log((h + 0.4) / (m + 0.4))
    gate = h + m > 0
    p = _squash(np.clip(np.where(gate, 0.4 * counts + 0.8 * history, counts), -12, 12))
    total = np.where(asked, np.log10(np.where(hit, p, 1 - p)), 0.0) + np.where(hit, 0.0, spelled)
    return np.bincount(owner, weights=total, minlength=len(n_chunks))


def _score_parts(n: int, v: int, end_c: int, kind: pa.DataType):
    total = np.log10(n + (v + 1))
    names = {"doc_id": kind, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64()}

    def work(parts: pa.Table, side: pa.Table) -> pa.Table:
        out = []
        kinds = side.column("lid").is_valid().to_numpy()
        get = lambda c, mask: side.column(c).to_numpy()[mask]
        lid = get("lid", kinds).astype(np.int64)
        c = np.zeros(int(lid.max()) + 1 if len(lid) else 0, np.int64)
        c[lid] = get("c", kinds)
        base = np.log10(c + 1) - total
        ctx = get("ctx", ~kinds).astype(np.int64) if (~kinds).any() else np.zeros(0, np.int64)
        if (~kinds).any():  # whole numbers as they are: a null makes pandas-like doubles of them
            rows = side.filter(pc.is_null(side.column("lid")))
            ctx, best, n_best, n_all = (rows.column(x).to_numpy() for x in ("ctx", "f", "n_best", "c"))
            order = np.argsort(ctx)
            ctx, best, n_best, n_all = ctx[order], best[order], n_best[order], n_all[order]
        else:
            ctx = best = n_best = n_all = np.zeros(0, np.int64)
        for k in range(parts.num_rows):
            row = {name: parts.column(name)[k] for name in parts.column_names}
            distinct, n_chunks, held = row["n_distinct"].values.to_numpy(), row["n_chunks"].values.to_numpy(), row["held"].values.to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(distinct)), distinct)
            step, times = _unplanes(row["ids"].as_py()), _unplanes(row["counts"].as_py())
            begin = np.cumsum(distinct) - distinct
            run = np.cumsum(step)
            before = np.concatenate(([0], run))[begin]  # steps restart with each document
            ids = run - before[owner] if len(run) else run
            sums = lambda x: np.bincount(owner, weights=x, minlength=len(distinct))
            found, spelled = np.frombuffer(row["chunks"].as_py(), "<i8"), np.frombuffer(row["spelled"].as_py(), "<f4").astype(np.float64)
            out.append(pa.table({
                "doc_id": pa.array(row["doc_ids"].values.to_pylist(), kind),
                "held_out": row["held"].values,
                "n_tokens": row["n_tokens"].values,
                "n_known": pa.array(sums(times * (c[ids] > 0)).astype(np.int64) + (end_c > 0)),
                "train_tokens": pa.array(np.full(len(distinct), n, np.int64)),
                "base_score": pa.array(sums(times * base[ids]) + np.log10(end_c + 1) - total),
                "score": pa.array(passage_score(found, spelled, n_chunks, held, ctx, best, n_best, n_all)),
                "n_bytes": row["n_bytes"].values,
            }))
        return pa.concat_tables(out) if out else pa.table({x: pa.array([], k) for x, k in names.items()})

    return work


def scores(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    arrow_kind = pa.string() if kind.simpleString() == "string" else pa.int64()
    name = "string" if arrow_kind == pa.string() else "bigint"
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % options.held_out_of == options.held_out_is, F.lit(False))
    rows = common.texts(docs).select(F.col("doc_id").cast(name).alias("doc_id"), "text", held.alias("held"))
    with _frugal(spark):
        model = fit(rows.where(~F.col("held")).select("text", F.xxhash64("doc_id", F.lit(1)).alias("pick")), options)
        sent = spark.sparkContext.broadcast(model)
        made = common.materialize(rows.mapInArrow(_parts(sent, options, arrow_kind), PART_SCHEMA.format(name)), "parts")
        sent.unpersist()
    words = made.where("word is not null").select(F.col("part").alias("of_part"), "word", "lid", "n")
    parts = made.where("word is null").drop("word", "lid", "n")
    ends = parts.select(F.sum(F.size(F.filter("held", lambda x: ~x)).cast("long"))).first()[0] or 0
    # Successions that two documents share, at least one of them of the training set.
    pairs = parts.select("part", "n_chunks", "held", "chunks").mapInArrow(_successions, "of_part long, ctx long, f long, n_train long, n_all long")
    each = pairs.groupBy("ctx", "f").agg(F.sum("n_train").alias("n"), F.sum("n_all").alias("every"))
    shared = each.groupBy(F.col("ctx").alias("x")).agg(F.max(F.struct("n", "f")).alias("best"), F.sum("n").alias("c"), F.sum("every").alias("every")).where("best.n > 0 and every > 1")
    with _frugal(spark):
        counts = common.materialize(words.groupBy("word").agg(F.sum("n").alias("c")), "counts")
        shared = common.materialize(shared.select("x", "best.f", F.col("best.n").alias("n_best"), "c"), "shared")
    n, v = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    # At most ``frequent`` words: a bound that holds for any input. No other word has many rows.
    often = F.col("c") * options.frequent >= max(n, 1)
    top = counts.where(often).select(F.col("word").alias("w"), F.col("c").alias("top_c"))
    marked = words.select("of_part", "lid", "word").join(F.broadcast(top), F.col("word") == F.col("w"), "left")
    rest = counts.where(~often).withColumnRenamed("word", "w2")
    known = marked.where("top_c is not null").select("of_part", "lid", F.col("top_c").alias("c")).unionByName(
        marked.where("top_c is null").select("of_part", "lid", "word").join(rest, F.col("word") == F.col("w2")).select("of_part", "lid", "c")
    )
    asked = pairs.select("of_part", "ctx").join(shared, F.col("ctx") == F.col("x")).drop("x").distinct()
    side = known.select("of_part", "lid", "c").unionByName(asked, allowMissingColumns=True)
    out = "doc_id {}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long".format(name)
    met = parts.groupBy("part").cogroup(side.groupBy("of_part")).applyInArrow(_score_parts(n, v, ends, arrow_kind), out)
    return met.withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / F.col("n_bytes")).drop("n_bytes")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"))
