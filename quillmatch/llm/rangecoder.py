"""Adaptive context-mixing range coder for token ids.

A segment is cut into blocks of ``block`` ids. Each block starts from the same
state, has its own code words and CRC-32, and can be decoded alone. For each id
three predictors offer a guess: order 2 (the id that followed the last two ids
in this block), order 1 (the id that followed the last one) and order 0 (the
distribution of ids in the segment, kept in its header). Two adaptive
probabilities, one by the confidence of order 2, one by that of order 1 and
whether both agree, are mixed in the logistic domain by weights that learn from
each coded id; the result is the probability of the order-2 guess. The rest goes
to order 1 by an adaptive probability, and then to order 0. The interval found
that way (of 2**30) drives a 64-bit range coder with 32-bit words and carries.

All arithmetic is on whole numbers, so any machine decodes what another wrote.
Blocks are coded in step: each numpy operation handles one position of
thousands of blocks, which is what makes Python fast enough here.

Format, little-endian: magic, uint64 ids, uint32 block, uint32 symbols,
uint32 blocks, uint32 size of the packed symbol table; the table (zlib over
int32 gaps between ids, then int32 frequencies); for each block uint32 words and
uint32 CRC-32 of its ids as uint32; then the blocks' words as uint32.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"QMCX"
HEAD = struct.Struct("<4sQIIII")
BLOCK = 1024
#: Blocks coded in step at a time; bounds the memory (about 13 KB a block).
LANES = 8192
SLOT_BITS = 10
SYMBOL_BITS, CLASS_BITS = 18, 12
WORD = np.uint64(32)
_LAST = np.uint64((1 << SYMBOL_BITS + CLASS_BITS) - 1)

_ONE, _TWO, _SHIFT, _MASK = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(32 - SLOT_BITS), np.uint32((1 << SLOT_BITS) - 1)

_x = np.arange(-2047, 2048)
#: 12-bit logistic function and its inverse, rounded to whole numbers.
_SQUASH = np.clip(np.round(4096 / (1 + np.exp(-_x / 256.0))), 1, 4090).astype(np.int32)
_STRETCH = np.clip(np.round(256.0 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))), -2047, 2047).astype(np.int32)


class _Model:
    """The state of ``n`` blocks in step, in 32-bit whole numbers."""

    def __init__(self, n: int) -> None:
        lane = np.arange(n, dtype=np.int64)
        self.slots = lane << SLOT_BITS
        self.two = np.zeros(n << SLOT_BITS, np.int32)  # id * 4 + confidence
        self.one = np.zeros(n << SLOT_BITS, np.int32)
        self.by_two = np.tile(np.array([1 << 9, 1 << 14, 1 << 15, 3 << 14], np.int32), n)
        self.by_one = np.tile(np.array([1 << 9, 1 << 10, 1 << 13, 1 << 15, 1 << 13, 3 << 14, 1 << 14, 7 << 13], np.int32), n)
        self.second = np.tile(np.array([1 << 8, 1 << 12, 1 << 13, 1 << 14], np.int32), n)
        self.at4, self.at8 = lane * 4, lane * 8
        self.weight_two = np.full(n, 1 << 15, np.int32)
        self.weight_one = np.full(n, 1 << 15, np.int32)
        self.hash_one = np.zeros(n, np.uint32)
        self.hash_two = np.zeros(n, np.uint32)
        self.time = 0

    def predict(self):
        """The guesses of orders 2 and 1, and the bounds (of 2**12) of their classes."""
        self.i1 = (self.hash_one >> _SHIFT & _MASK) + self.slots
        self.i2 = (self.hash_one + self.hash_two >> _SHIFT & _MASK) + self.slots
        self.e2, self.e1 = self.two.take(self.i2), self.one.take(self.i1)
        self.g2, self.g1 = self.e2 >> 2, self.e1 >> 2
        self.c2, self.c1 = self.e2 & 3, self.e1 & 3
        self.same = self.g2 == self.g1
        self.j2 = self.at4 + self.c2
        self.j0 = self.at4 + self.c1
        self.j1 = self.at8 + (self.c1 | self.same.view(np.int8) << 2)
        self.p2, self.p1, self.p0 = self.by_two.take(self.j2), self.by_one.take(self.j1), self.second.take(self.j0)
        self.s2, self.s1 = _STRETCH.take(self.p2 >> 4), _STRETCH.take(self.p1 >> 4)
        mixed = (self.weight_two * self.s2 + self.weight_one * self.s1 >> 16) + 2047
        self.p = _SQUASH.take(mixed, mode="clip")
        rest = ((4094 - self.p) * (self.p0 >> 4) >> 12) + 1
        self.bound = np.where(self.same, self.p, self.p + rest)
        return self.g2, self.g1, self.p, self.bound

    def learn(self, ids: np.ndarray) -> None:
        """Take in the ids (int32) that were coded."""
        hit2, hit1 = self.g2 == ids, self.g1 == ids
        h2 = hit2.astype(np.int32)
        error = h2 * 4095 - self.p
        self.weight_two += self.s2 * error >> 10
        self.weight_one += self.s1 * error >> 10
        self.time += 1
        if not self.time % 16:  # 16 steps can't carry a weight out of 32 bits
            for w in (self.weight_two, self.weight_one):
                np.minimum(np.maximum(w, -(1 << 18), out=w), 1 << 18, out=w)
        goal = h2 * 65535
        self.by_two[self.j2] = self.p2 + (goal - self.p2 >> 5)
        self.by_one[self.j1] = self.p1 + (goal - self.p1 >> 5)
        self.second[self.j0] = np.where(hit2 | self.same, self.p0, self.p0 + (hit1.astype(np.int32) * 65535 - self.p0 >> 5))
        fresh = ids * 4 + 1
        self.two[self.i2] = np.where(hit2, self.e2 + (self.c2 < 3), np.where(self.c2 > 1, self.e2 - 1, fresh))
        self.one[self.i1] = np.where(hit1, self.e1 + (self.c1 < 3), np.where(self.c1 > 1, self.e1 - 1, fresh))
        self.hash_two = self.hash_one * _TWO
        self.hash_one = ids.view(np.uint32) * _ONE


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**18, each at least 1."""
    total = 1 << SYMBOL_BITS
    if len(counts) > total:
        raise ValueError("too many different ids in a segment")
    scaled = 1 + counts * (total - len(counts)) // counts.sum()
    scaled[np.argmax(scaled)] += total - scaled.sum()
    return scaled


def _encode_lanes(ranks: np.ndarray, symbols: np.ndarray, start: np.ndarray, freq: np.ndarray) -> list[np.ndarray]:
    """Code words of each block; ranks (blocks x positions) are places among the symbols."""
    n, length = ranks.shape
    model = _Model(n)
    low = np.zeros(n, np.uint64)
    span = np.full(n, (1 << 64) - 1, np.uint64)
    words = np.zeros((n, length * 30 // 32 + 4), np.int64)
    used = np.zeros(n, np.int64)
    ranks = np.ascontiguousarray(ranks.T)
    for t in range(length):
        rank = ranks[t]
        now = symbols.take(rank)
        g2, g1, p, bound = model.predict()
        hit2, hit1 = g2 == now, g1 == now
        low_end, high_end, left = p << SYMBOL_BITS, bound << SYMBOL_BITS, 4096 - bound
        begin = np.where(hit2, 0, np.where(hit1, low_end, high_end + left * start.take(rank)))
        width = np.where(hit2, low_end, np.where(hit1, high_end - low_end, left * freq.take(rank)))
        unit = span >> np.uint64(SYMBOL_BITS + CLASS_BITS)
        new = low + unit * begin.astype(np.uint64)
        span = unit * width.astype(np.uint64)
        over = np.flatnonzero(new < low)
        if len(over):
            words[over, used[over] - 1] += 1
        low = new
        small = np.flatnonzero(span < (1 << 32))
        if len(small):
            part = low[small]
            words[small, used[small]] = (part >> WORD).astype(np.int64)
            used[small] += 1
            low[small] = part << WORD
            span[small] <<= WORD
        model.learn(now)
    lanes = np.arange(n)
    words[lanes, used] = (low >> WORD).astype(np.int64)
    words[lanes, used + 1] = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    used += 2
    words = words[:, : int(used.max())]
    while len((over := np.nonzero(words >> 32))[0]):
        words[over] &= 0xFFFFFFFF
        words[over[0], over[1] - 1] += 1
    return [w[:k].astype("<u4") for w, k in zip(words, used.tolist())]


def _decode_lanes(words: np.ndarray, first: np.ndarray, length: int, symbols: np.ndarray, start: np.ndarray, freq: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Ids (blocks x length) from the words of all blocks, which begin at ``first``."""
    n = len(first)
    model = _Model(n)
    words = np.concatenate([words, np.zeros(4, words.dtype)])
    at = first.copy()
    code = words[at].astype(np.uint64) << WORD | words[at + 1].astype(np.uint64)
    at += 2
    span = np.full(n, (1 << 64) - 1, np.uint64)
    out = np.empty((length, n), np.int32)
    for t in range(length):
        g2, g1, p, bound = model.predict()
        unit = span >> np.uint64(SYMBOL_BITS + CLASS_BITS)
        value = np.minimum(code // unit, _LAST).astype(np.int32)
        low, high, left = p << SYMBOL_BITS, bound << SYMBOL_BITS, 4096 - bound
        hit2 = value < low
        hit1 = value < high
        rank = slot.take((value - high) // left, mode="clip")
        begin = np.where(hit2, 0, np.where(hit1, low, high + left * start.take(rank)))
        width = np.where(hit2, low, np.where(hit1, high - low, left * freq.take(rank)))
        now = np.where(hit2, g2, np.where(hit1, g1, symbols.take(rank)))
        code -= unit * begin.astype(np.uint64)
        span = unit * width.astype(np.uint64)
        small = np.flatnonzero(span < (1 << 32))
        if len(small):
            k = at[small]
            code[small] = code[small] << WORD | words.take(k, mode="clip").astype(np.uint64)
            at[small] = k + 1
            span[small] <<= WORD
        out[t] = now
        model.learn(now)
    return np.ascontiguousarray(out.T)


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """One segment of token ids (0 <= id < 2**29)."""
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 29):
        raise ValueError("ids must lie in 0 .. 2**29 - 1")
    ids = ids.astype(np.int32)
    top = int(ids.max()) + 1 if len(ids) else 0
    if top <= 1 << 22:
        counts = np.bincount(ids, minlength=1)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        place = np.zeros(top, np.int32)
        place[symbols] = np.arange(len(symbols), dtype=np.int32)
        ranks = place[ids]
    else:
        symbols, ranks, counts = np.unique(ids, return_inverse=True, return_counts=True)
    n_blocks = -(-len(ids) // block)
    freq = _frequencies(counts.astype(np.int64)) if len(ids) else np.zeros(0, np.int64)
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<i4").tobytes() + freq.astype("<i4").tobytes(), 6)
    parts = [HEAD.pack(MAGIC, len(ids), block, len(symbols), n_blocks, len(table)), table]
    if not n_blocks:
        return b"".join(parts)
    freq, symbols32 = freq.astype(np.int32), symbols.astype(np.int32)
    start = (np.cumsum(freq) - freq).astype(np.int32)
    index, payload = [], []
    for k in range(0, n_blocks, LANES):
        mine = slice(k * block, min(n_blocks, k + LANES) * block)
        some, rank = ids[mine], ranks[mine]
        gap = -len(some) % block
        if gap:
            some, rank = np.concatenate([some, np.full(gap, symbols[0], np.int32)]), np.concatenate([rank, np.zeros(gap, rank.dtype)])
        some, rank = some.reshape(-1, block), rank.reshape(-1, block)
        for row, words in zip(some, _encode_lanes(rank, symbols32, start, freq)):
            index.append(struct.pack("<II", len(words), zlib.crc32(row.astype("<u4").tobytes())))
            payload.append(words.tobytes())
    return b"".join(parts + index + payload)


def decode(data: bytes, only: int | None = None) -> np.ndarray:
    """The ids of a segment, or of block ``only``; checks every block's CRC-32."""
    magic, n, block, n_symbols, n_blocks, size = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of this format")
    if not n_blocks:
        return np.zeros(0, np.int32)
    table = np.frombuffer(zlib.decompress(data[HEAD.size : HEAD.size + size]), "<i4")
    symbols = np.cumsum(table[:n_symbols]).astype(np.int32)
    freq = table[n_symbols:].astype(np.int32)
    start = (np.cumsum(freq) - freq).astype(np.int32)
    slot = np.repeat(np.arange(n_symbols, dtype=np.int32), freq)
    at = HEAD.size + size
    index = np.frombuffer(data, "<u4", 2 * n_blocks, at).reshape(-1, 2)
    words = np.frombuffer(data, "<u4", int(index[:, 0].sum()), at + index.nbytes)
    first = np.cumsum(index[:, 0].astype(np.int64)) - index[:, 0]
    wanted = range(n_blocks) if only is None else range(only, only + 1)
    out = []
    for k in range(wanted.start, wanted.stop, LANES):
        mine = slice(k, min(wanted.stop, k + LANES))
        begin = first[mine]
        stop = int(begin[-1]) + int(index[mine][-1, 0])
        rows = _decode_lanes(words[int(begin[0]) : stop], begin - begin[0], block, symbols, start, freq, slot)
        for row, crc in zip(rows, index[mine, 1].tolist()):
            if zlib.crc32(row.astype("<u4").tobytes()) != crc:
                raise ValueError("a block does not match its checksum")
        out.append(rows.reshape(-1))
    ids = np.concatenate(out)
    return ids[: n if only is None else min(block, n - only * block)]
