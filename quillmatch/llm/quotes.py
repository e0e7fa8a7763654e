"""Quotation linking: conversations in reply order, without quotes.

Lines that begin with ``>`` marks are quotes; the number of marks is the level.
Consecutive lines of one level form a passage. Passages and the units of a
message that can be quoted (its whole own text, its paragraphs, lines and
sentences) are normalised (lower case, single spaces) and hashed. A passage is
joined, in this order,

1. to the last earlier message of its conversation that holds it as a unit,
2. to the last earlier message of its conversation whose own words hold the
   passage's words in a row (a part of a sentence, some of the lines),
3. to the earlier message of its conversation that holds most words of the
   passage's own paragraphs, lines and sentences, each looked up like 2,
4. to the first message of all conversations that holds it, else one of its
   paragraphs, lines or sentences, as a unit of ``min_words`` words or more.

Words in 2 and 3 are without case and punctuation; in scripts without spaces each
character is a word. Only messages of conversations with passages that 1 leaves
open are cut into runs of words, of the lengths looked for there. The joins are
sorted passes over quotes and units with equal hashes, so a line that occurs in
very many messages costs one row each and never all pairs.

A message's parent is the last earlier message of its conversation that its
quotes of level 1 link to. Threads are found by pointer jumping. Sorting by
(conv_id, thread_turn, turn) gives the conversations in reply order: a thread
stands together, and each reply follows what it replies to.

Defined cases: null text counts as empty. A message with a null conv_id or turn
links to nothing and is its own thread. Repeated rows of one message appear as
often as they occur, with the same parent. Without quotes every message is its
own thread, which leaves the order of turns. An empty table gives an empty
result. Other columns are not read, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WHITE = re.compile(r"\s+")
#: Thai to Lao, Burmese, Khmer, kana and Han: written without spaces.
_UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")


@dataclass(frozen=True)
class Options:
    #: Of units that link to other conversations.
    min_words: int = 3


def _introduces(line: str) -> bool:
    """Whether a line of any length ends with the word that introduces a quote."""
    line = line.rstrip()
    return line.endswith("wrote:") and not (line[:-6][-1:].isalnum() or line[:-6][-1:] == "_")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text without quotes, passages as (level, text))."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        m = _MARKS.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        else:
            if not before and own and _introduces(own[-1]):
                own.pop()  # the line that introduces a quote
            if before == level:
                passages[-1][1].append(line[m.end() :])
            else:
                passages.append((level, [line[m.end() :]]))
        before = level
    if not passages:
        return text, []
    return "\n".join(own).strip("\n"), [(level, "\n".join(lines)) for level, lines in passages]


def normalise(text: str) -> str:
    return _WHITE.sub(" ", text).strip().lower()


def units(text: str) -> list[str]:
    """What others can quote: the text, its paragraphs, lines and sentences."""
    found = [text, *re.split(r"\n\s*\n", text), *text.split("\n"), *_SENTENCE.split(text)]
    return list(dict.fromkeys(filter(None, map(normalise, found))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def _length(text: str) -> int:
    return text.count(" ") + 1


def runs(text: str, sizes: list[int]) -> list[int]:
    """Hashes of all runs of so many words; size 0: of the units without words."""
    words = [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(text.lower())]
    flat, starts = b" ".join(words), [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    found = {_hash(u) for u in units(text) if not _WORD.search(u)} if 0 in sizes else set()
    for n in filter(None, sizes):
        found.update(_signed(xxhash.xxh64_intdigest(flat[a : b - 1])) for a, b in zip(starts, starts[n:]))
    return list(found)


def pieces(passage: str) -> list[dict[str, int]]:
    """The passage and its own units: hash, number of words between spaces, and
    number and hash of the words that runs() looks at."""
    out = []
    for u in units(passage):
        words = _WORD.findall(u)
        out.append({"hash": _hash(u), "n": _length(u), "size": len(words), "run": _hash(" ".join(words)) if words else _hash(u)})
    return out


_PIECE = pa.struct([(c, pa.int64()) for c in ("hash", "n", "size", "run")])
_QUOTES = pa.list_(pa.struct([("level", pa.int64()), ("hash", pa.int64()), ("pieces", pa.list_(_PIECE))]))
_QUOTES_SQL = "array<struct<level:bigint,hash:bigint,pieces:array<struct<hash:bigint,n:bigint,size:bigint,run:bigint>>>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, quotes = [], []
        for text in batch.column(3).to_pylist():
            mine, passages = parse(text)
            own.append(mine)
            some = [(level, pieces(p)) for level, p in passages]
            quotes.append([{"level": level, "hash": found[0]["hash"], "pieces": found} for level, found in some if found])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.string()), pa.array(quotes, _QUOTES)], names=["conv_id", "turn", "role", "text", "quotes"])


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, turn, hash and n of each unit of (conv_id, turn, text)."""
    for batch in batches:
        found = [units(x) for x in batch.column(2).to_pylist()]
        row = pa.array([i for i, some in enumerate(found) for _ in some], pa.int64())
        flat = [u for some in found for u in some]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(map(_hash, flat), pa.int64()), pa.array(map(_length, flat), pa.int64())], names=["conv_id", "turn", "hash", "n"])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, turn and run of (conv_id, turn, text, sizes)."""
    for whole in batches:
        for k in range(0, whole.num_rows, 100):
            batch = whole.slice(k, 100)
            found = [runs(x, sizes) for x, sizes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            row = pa.array([i for i, some in enumerate(found) for _ in some], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array([h for some in found for h in some], pa.int64())], names=["conv_id", "turn", "run"])


def _nearest(every: DataFrame, quotes: DataFrame, key: str) -> DataFrame:
    """The quotes with near, the last earlier turn of the conversation with their key."""
    # Quotes come before units of their own turn, so a message can't quote itself.
    both = every.select("conv_id", "turn", key).withColumn("kind", F.lit(1)).unionByName(quotes.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("conv_id", key).orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("near", F.last(F.when(F.col("kind") == 1, F.col("turn")), ignorenulls=True).over(order)).where("kind = 0").drop("kind")


def _pieces_of(quotes: DataFrame) -> DataFrame:
    return quotes.select("conv_id", "turn", "level", F.col("hash").alias("passage"), F.posexplode("pieces").alias("pos", "p")).select(
        "conv_id", "turn", "level", "passage", (F.col("pos") == 0).alias("whole"), "p.hash", "p.n", "p.size", "p.run"
    )


def _threads(parents: DataFrame) -> DataFrame:
    """conv_id, turn, thread_turn and depth of each message that has a parent."""
    state = common.materialize(parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        step = state.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        joined = state.join(step, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left")
        state = common.materialize(joined.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")), "threads")
        if state.where("moved").isEmpty():
            return state.select("conv_id", "turn", F.col("up").alias("thread_turn"), "depth")
        state = state.drop("moved")


def link(messages: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(messages in reply order without quotes, links of passages to their origins)."""
    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")}
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), f"text string, quotes {_QUOTES_SQL}"])
    rows = common.materialize(rows.mapInArrow(_parsed, schema), "messages")
    known = rows.where("conv_id is not null and turn is not null")
    quotes = known.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.hash", "q.pieces").distinct()
    quotes = common.materialize(quotes, "quotes")
    plain = rows.select("conv_id", "turn", "role", "text", F.size("quotes").cast("long").alias("n_quotes"))
    if quotes.isEmpty():
        nothing = F.lit(None).cast(kinds["turn"])
        out = plain.withColumns({"parent_turn": nothing, "thread_turn": F.col("turn"), "depth": F.lit(0).cast("long"), "n_linked": F.lit(0).cast("long")})
        links = quotes.drop("pieces").withColumns({"origin_conv": F.lit(None).cast(kinds["conv_id"]), "origin_turn": nothing})
        return _ordered_columns(out), links
    at = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}"
    passage = ["conv_id", "turn", "level", "passage"]
    wanted = _pieces_of(quotes).select(F.col("hash").alias("h")).distinct()
    every = known.select("conv_id", "turn", "text").mapInArrow(_unit_rows, f"{at}, hash long, n long").join(wanted, F.col("hash") == F.col("h"), "left_semi").distinct()
    every = common.materialize(every, "units")
    by_unit = common.materialize(_nearest(every, quotes, "hash"), "unit-links")
    # Inside the conversation: the words of the passage, or of its pieces, in a row.
    parts = common.materialize(_pieces_of(by_unit.where("near is null")), "pieces")
    sizes = parts.groupBy(F.col("conv_id").alias("c")).agg(F.collect_set("size").alias("sizes"))
    spots = known.select("conv_id", "turn", "text").distinct().join(sizes, F.col("conv_id") == F.col("c")).select("conv_id", "turn", "text", "sizes").mapInArrow(_run_rows, f"{at}, run long")
    runs_wanted = parts.select(F.col("conv_id").alias("c"), F.col("run").alias("r")).distinct()
    spots = spots.join(runs_wanted, (F.col("conv_id") == F.col("c")) & (F.col("run") == F.col("r")), "left_semi").distinct()
    held = _nearest(spots, parts, "run").where("near is not null")
    votes = held.groupBy(*passage, "near").agg(F.max("whole").alias("whole"), F.sum("size").alias("words"))
    by_run = votes.groupBy(*passage).agg(F.max(F.struct("whole", "words", "near")).alias("x")).select(*passage, F.col("x.near").alias("run_turn"))
    by_run = common.materialize(by_run, "run-links")
    # Elsewhere: the first message of all that holds the passage or a piece as a unit.
    enough = F.col("n") >= options.min_words
    first = every.where(enough).groupBy(F.col("hash").alias("h")).agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    far = parts.where(enough).join(by_run.select(passage), passage, "left_anti").join(first, F.col("hash") == F.col("h")).where(F.col("first.conv_id") != F.col("conv_id"))
    votes = far.groupBy(*passage, "first").agg(F.max("whole").alias("whole"), F.sum("n").alias("words"))
    by_far = votes.groupBy(*passage).agg(F.max_by("first", F.struct("whole", "words", "first")).alias("first"))
    links = by_unit.select("conv_id", "turn", "level", F.col("hash").alias("passage"), "near").join(by_run, passage, "left").join(by_far, passage, "left")
    near = F.coalesce("near", "run_turn")
    links = common.materialize(links.select(
        "conv_id", "turn", "level", F.col("passage").alias("hash"),
        F.when(near.isNotNull(), F.col("conv_id")).otherwise(F.col("first.conv_id")).alias("origin_conv"),
        F.coalesce(near, "first.turn").alias("origin_turn"),
    ), "quote-links")
    inside = (F.col("level") == 1) & (F.col("origin_conv") == F.col("conv_id"))
    per = links.groupBy("conv_id", "turn").agg(F.max(F.when(inside, F.col("origin_turn"))).alias("parent_turn"), F.count("origin_conv").alias("n_linked"))
    parents = per.where("parent_turn is not null")
    threads = _threads(parents)
    k = lambda df, *c: df.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), *c)
    out = plain.join(k(per, "parent_turn", "n_linked"), (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").drop("_c", "_t")
    out = out.join(k(threads, "thread_turn", "depth"), (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left").drop("_c", "_t")
    out = out.withColumns({"thread_turn": F.coalesce("thread_turn", "turn"), "depth": F.coalesce("depth", F.lit(0)).cast("long"), "n_linked": F.coalesce("n_linked", F.lit(0)).cast("long")})
    return _ordered_columns(out), links


def _ordered_columns(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", "role", "text", "parent_turn", "thread_turn", "depth", "n_quotes", "n_linked")


def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.table(spark, sf_dir, "conversations"))[0]
