"""Token ids of a corpus, written and read in a binary format.

``write`` sorts the documents by doc_id (then text hash) into ranges, tokenizes
each range and writes segments: Parquet rows that hold the index (doc ids and
token counts) and the payload of :mod:`rangecoder`, which is the file format.
A segment ends after ``segment`` ids, at a document's end, so every segment is
decoded by one task in bounded memory. The manifest beside them gives the
segments' order and the ids before each. ``read`` decodes the payloads again.

Texts are split at ASCII white space first and every different word of a batch
is tokenized once. The tokenizer drops white space and never joins across it, so
the ids are those of the whole text; a tokenizer for which that does not hold
must be used with ``by_word=False``.

Defined cases: null text counts as empty (its ids are the end id alone). A null
doc_id sorts first. Repeated doc_ids follow each other, in the order of their
text hashes. An empty table gives no segments. Other columns are not read.
"""

from __future__ import annotations

import os
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, rangecoder

SCHEMA = "segment long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


@dataclass(frozen=True)
class Options:
    #: Path of the tokenizer's file; None takes the default file of the installed vocabularies.
    tokenizer: str | None = None
    end_id: int = 2
    by_word: bool = True
    #: Ids of a segment, at least (a document is never cut).
    segment: int = 8_000_000
    #: Characters tokenized at a time.
    batch: int = 18_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _flat(encodings) -> tuple[np.ndarray, np.ndarray]:
    ids = [np.array(e.ids, np.int32) for e in encodings]
    return np.concatenate([np.zeros(0, np.int32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))


#: Stands between words that are tokenized in one go; a character of its own token.
MARK, MARKED = "\x02", 1000


def _encode_words(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids) of each word; many words go to the tokenizer as one text."""
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids
    texts = [f" {MARK} ".join(words[k : k + MARKED]) for k in range(0, len(words), MARKED)]
    flat, per_text = _flat(tokenizer.encode_batch_fast(texts, add_special_tokens=False))
    # A text's last word has no mark behind it: its end is the text's end.
    at = np.flatnonzero(flat == mark[0])
    if len(mark) != 1 or len(at) != len(words) - len(texts):
        return _flat(tokenizer.encode_batch_fast(words, add_special_tokens=False))
    ends = np.sort(np.concatenate([at - np.arange(len(at)), np.cumsum(per_text) - np.searchsorted(at, np.cumsum(per_text))]))
    return np.delete(flat, at), np.diff(ends, prepend=0)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start .. start + length - 1 of every pair, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + (int(starts.max()) if len(starts) else 0) < 1 << 31 else np.int64
    shift = starts.astype(kind)
    shift -= (ends - lengths).astype(kind)
    out = np.repeat(shift, lengths)
    out += np.arange(total, dtype=kind)
    return out


def _without_normalizer(tokenizer):
    """A tokenizer that gives printable lower-case ASCII the same ids without its
    normalizer, where that is known to leave such text alone; else the same tokenizer."""
    spec = json.loads(tokenizer.to_str())
    rules = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
    rules = rules["normalizers"] if rules["type"] == "Sequence" else [rules]
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    known = all(r["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or r == spaces for r in rules)
    if not known or any(t["normalized"] for t in spec["added_tokens"]):
        return tokenizer
    lean = type(tokenizer).from_str(tokenizer.to_str())
    lean.normalizer = None
    return lean


class WordIds:
    """Ids of words. The first ``most`` different words that a Python worker meets
    are remembered: more than half of the words of any later text are among them."""

    def __init__(self, tokenizer, most: int = 900_000) -> None:
        self.tokenizer, self.most = tokenizer, most
        self.lean = _without_normalizer(tokenizer)
        self.known = pa.array([], pa.string())
        self.flat, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's ids begin, how many there are)."""
        words = words.cast(pa.string())
        place = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        new = np.flatnonzero(place < 0)
        plain = pc.match_substring_regex(words.take(pa.array(new)), r"^[!-@\[-~]+$").to_numpy(zero_copy_only=False)
        n_plain = int(plain.sum())
        new = np.concatenate([new[plain], new[~plain]])
        fresh = words.take(pa.array(new))
        some = [_encode_words(t, part.to_pylist()) for t, part in ((self.lean, fresh.slice(0, n_plain)), (self.tokenizer, fresh.slice(n_plain)))]
        flat, lengths = (np.concatenate(x) for x in zip(*some))
        every = np.concatenate([self.lengths, lengths.astype(np.int32)])
        place[new] = len(self.lengths) + np.arange(len(new))
        both = np.concatenate([self.flat, flat])
        starts = np.cumsum(every, dtype=np.int32) - every
        room = min(self.most - len(self.known), len(new))
        if room > 0:
            self.known = pa.concat_arrays([self.known, fresh.slice(0, room)])
            self.lengths = every[: len(self.known)].copy()
            self.flat = both[: int(self.lengths.sum())].copy()
        return both, starts[place], every[place]


#: By tokenizer file: lives as long as the Python worker.
_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(_tokenizer(path))
    return _words[path]


def tokenize(words: WordIds, texts: pa.Array, by_word: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, number of ids of each text)."""
    if not by_word:
        return _flat(words.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False))
    # The tokenizer lower-cases; only the strings of special tokens must keep their case.
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(lists).dictionary_encode()
    flat, starts, lengths = words.ids(coded.dictionary)
    index = coded.indices.to_numpy()
    each = lengths.take(index)
    ids = flat.take(_spread(starts.take(index), each))
    ends = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum(per_text)))]
    return ids, np.diff(ends)


def _with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(lengths), end_id, np.int32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(lengths + 1) - 1] = False
    out[keep] = ids
    return out, lengths + 1


def _segments(options: Options):
    path = options.tokenizer or default_tokenizer()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        base = TaskContext.get().partitionId() << 32
        docs, ids, lengths, held, sent = [], [], [], 0, 0

        def flush():
            nonlocal docs, ids, lengths, held, sent
            every, ids = np.concatenate(ids), []
            payload = rangecoder.encode(every)
            del every
            per = np.concatenate(lengths)
            row = pa.RecordBatch.from_arrays([
                pa.array([base + sent], pa.int64()), pa.array([held], pa.int64()), pa.array([pa.concat_arrays(docs).to_pylist()], pa.list_(pa.int64())),
                pa.array([per], pa.list_(pa.int64())), pa.array([payload], pa.binary()),
            ], names=["segment", "n_ids", "doc_ids", "lengths", "payload"])
            docs, ids, lengths, held = [], [], [], 0
            sent += 1
            return row

        for whole in batches:
            sizes = pc.binary_length(whole.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // options.batch)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows]):
                if a == b:
                    continue
                batch = whole.slice(a, b - a)
                flat, per = _with_end(*tokenize(words, batch.column(1), options.by_word), options.end_id)
                pa.default_memory_pool().release_unused()  # a worker lives on and would keep it
                doc = batch.column(0).cast(pa.int64())
                # Cut where a segment is full, at a document's end.
                ends, begin, done = np.cumsum(per), 0, 0
                while begin < len(per):
                    stop = min(len(per), int(np.searchsorted(ends, done + options.segment - held)) + 1)
                    upto = int(ends[stop - 1])
                    docs.append(doc.slice(begin, stop - begin))
                    ids.append(flat[done:upto])
                    lengths.append(per[begin:stop])
                    held += upto - done
                    begin, done = stop, upto
                    if held >= options.segment:
                        yield flush()
        if lengths:
            yield flush()

    return work


def write(docs: DataFrame, path: str, options: Options = Options()) -> None:
    """Write the segments to ``path``/data and the manifest to ``path``/manifest."""
    spark = docs.sparkSession
    rows = common.texts(docs).withColumn("th", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    rows.mapInArrow(_segments(options), SCHEMA).write.parquet(f"{path}/data")
    # One row per segment of millions of ids: file metadata, which the driver lists.
    segments = spark.read.schema(SCHEMA).parquet(f"{path}/data").select("segment", "n_ids").orderBy("segment").collect()
    start, manifest = 0, []
    for s in segments:
        manifest.append((s["segment"], start, s["n_ids"]))
        start += s["n_ids"]
    spark.createDataFrame(manifest, "segment long, start long, n_ids long").coalesce(1).write.parquet(f"{path}/manifest")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            segment, doc_ids, lengths, payload = (batch.column(i)[k] for i in range(4))
            ids = rangecoder.decode(payload.as_py()).astype("<u4")
            per = lengths.values.to_numpy().astype(np.int64)
            ends = np.cumsum(per)
            if len(ids) != (int(ends[-1]) if len(ends) else 0):
                raise ValueError("a segment's index does not match its ids")
            raw = memoryview(ids).cast("B")
            starts = ends - per
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(per), segment.as_py(), np.int64)), doc_ids.values, pa.array(starts), pa.array(per), pa.array(crc, pa.int64()),
            ], names=["segment", "doc_id", "offset", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and ids_crc32."""
    data = spark.read.schema(SCHEMA).parquet(f"{path}/data").select("segment", "doc_ids", "lengths", "payload")
    rows = data.mapInArrow(_decoded, "segment long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    first = spark.read.schema("segment long, start long, n_ids long").parquet(f"{path}/manifest").select(F.col("segment").alias("s"), F.col("start").alias("before"))
    return rows.join(first, F.col("segment") == F.col("s")).select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, options: Options = Options()) -> DataFrame:
    path = common.scratch_path(docs.sparkSession, "tokens")
    write(docs, path, options)
    return read(docs.sparkSession, path)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
