"""Benchmark decontamination by template windows (DataFrame functions only).

Words are canonicalised into templates: numbers become ``<num>``, units
``<unit>``, capitalised words inside a sentence ``<name>`` (and, in any case, the
words that the benchmark writes with a capital only); all others are lower-cased
and stripped of surrounding punctuation. Every window of ``window``
template words of a benchmark item is hashed; a document's windows are hashed
the same way and met with them by hash. Where they meet, the template words are
compared again (so no hash collision counts), and the slots of all windows of
one alignment (document, item, offset) are collected: within an alignment each
slot value of the item must always stand for the same value in the document.
A re-parameterised question passes this; chance matches of placeholders do not.
Windows need at least ``min_plain`` words that are no placeholders. Words that
are units and ordinary words as well (``AMBIGUOUS``) are units after a number only.

An item counts as leaked into a document when the consistent alignments cover
at least ``coverage`` of the item's windows, or when windows met word for word
follow one another without a gap over ``run`` words in one of these alignments,
whatever share of the item that is. Items shorter than the window are
one window of all their words. Items without any window (under ``min_words``
words, or all windows short of plain words) leak where all their words stand in
a row with their own values; signs that stand alone count as words there, as
the signs of a formula do.

One scan of the documents serves a benchmark of any size: a table of flags
(``flags`` a window, 16 MB at most) lets a row keep the windows that may be of
the benchmark, and these are hash-joined with it, so no text is shuffled.

Two values of an item may stand for one value of the document ("12 and 7" asked
again as "9 and 9"), but not one value for two.

Defined cases: null texts count as empty and leak nothing; ties do not arise, as
every leaked item is reported. Repeated rows of one doc_id are counted together.
Repeated benchmark items are reported each. Very long texts are read whole. Empty tables give an empty result
(an empty benchmark leaves all documents). Other columns are passed through by
``clean`` and not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Units that are replaced by a placeholder.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec secs min mins h hr hrs "
    "meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "percent dollar dollars cent cents euro euros usd eur"
).split()
#: Units that are ordinary words (or letters) too.
AMBIGUOUS = "in m g t l s h min mi second".split()
NUMBER = r"^[+-]?[0-9][0-9.,]*(%|st|nd|rd|th)?$"
SPACE = r"[ \x09-\x0D]+"
WORDLIKE = r"[\p{L}\p{N}]"
AROUND = r"^[^\p{L}\p{N}+\-]+|[^\p{L}\p{N}%]+$"


@dataclass(frozen=True)
class Options:
    window: int = 8
    min_words: int = 5
    min_plain: int = 4
    coverage: float = 0.5
    #: Words of a verbatim excerpt that leaks by itself.
    run: int = 13
    #: Flags a window of the benchmark; fewer only make more windows go to the join.
    flags: int = 16
    #: Benchmarks with more windows are joined by a shuffle instead of a broadcast.
    broadcast_windows: int = 200_000


def _bare(df: DataFrame) -> DataFrame:
    """Adds raw (words with a letter or digit) and bare (without surrounding punctuation)."""
    df = df.withColumn("raw", F.filter(F.split("text", SPACE), lambda w: w.rlike(WORDLIKE))).drop("text")
    return df.withColumn("bare", F.transform("raw", lambda w: F.regexp_replace(w, AROUND, "")))


def _literal(df: DataFrame) -> DataFrame:
    """Adds literal (words without case and surrounding punctuation, and signs that stand alone)."""
    every = F.filter(F.split("text", SPACE), lambda w: w != "")
    return df.withColumn("literal", F.transform(every, lambda w: F.when(w.rlike(WORDLIKE), F.lower(F.regexp_replace(w, AROUND, ""))).otherwise(w))).drop("text")


def _inside(i: Column) -> Column:
    """The word at i does not begin a sentence."""
    return (i > 0) & ~F.get("raw", i - 1).rlike(r"[.!?:]$")


def _capital(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}\p{Ll}+$")


def _tokens(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds plain (words without case and surrounding punctuation) and shape (templates)."""
    return _bare(df).withColumns({
        "plain": F.transform("bare", F.lower),
        "shape": F.transform("bare", lambda w, i: _template(w, _inside(i), F.get("bare", i - 1), names)),
    }).drop("raw", "bare")


def _template(word: Column, inside: Column, before: Column, names: list[str]) -> Column:
    low = F.lower(word)
    unit = low.isin(UNITS) & (~low.isin(AMBIGUOUS) | before.rlike(NUMBER))
    name = inside & _capital(word)
    return (
        F.when(word.rlike(NUMBER), "<num>")
        .when(unit, "<unit>")
        .when(name | low.isin(names) if names else name, "<name>")
        .otherwise(low)
    )


def _items(benchmark: DataFrame) -> DataFrame:
    return common.texts(benchmark.select(F.col("item_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "item_id")


def benchmark_names(benchmark: DataFrame) -> list[str]:
    """Words that the benchmark writes with a capital inside sentences and never
    without: they are names in texts of any case. Part of the query set."""
    words = _bare(_items(benchmark)).select(F.explode(F.transform("bare", lambda w, i: F.struct(w.alias("w"), (_inside(i) & _capital(w)).alias("name")))).alias("x"))
    kinds = words.groupBy(F.lower("x.w").alias("w")).agg(F.max("x.name").alias("name"), F.max(F.col("x.w").rlike(r"^\p{Ll}")).alias("plain"))
    return sorted(r["w"] for r in kinds.where("name and not plain").collect())


def _window_hashes(hashes: str, window: int) -> Column:
    """The hash of the window that starts at each word; null if there are too few words."""
    return F.when(
        F.size(hashes) >= window,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)])),
    )


def benchmark_windows(benchmark: DataFrame, names: list[str], options: Options = Options()) -> DataFrame:
    """hash, size, item_id, at, shape and plain (of the window), n_windows of the item."""
    items = _tokens(_items(benchmark), names)
    items = items.withColumn("size", F.least(F.lit(options.window), F.size("shape"))).where(F.col("size") >= options.min_words)
    rows = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("shape") - F.col("size"))))
    rows = rows.withColumns({"shape": F.slice("shape", F.col("at") + 1, F.col("size")), "plain": F.slice("plain", F.col("at") + 1, F.col("size"))})
    rows = rows.where(F.size(F.filter("shape", lambda w: ~w.startswith("<"))) >= F.least(F.lit(options.min_plain), F.col("size")))
    hashed = F.lit(None).cast("long")
    for n in range(options.min_words, options.window + 1):
        hashed = F.when(F.col("size") == n, F.xxhash64(*[F.xxhash64(F.get("shape", F.lit(k))) for k in range(n)])).otherwise(hashed)
    rows = rows.withColumn("hash", hashed)
    totals = rows.groupBy("item_id").agg(F.count("*").alias("n_windows")).withColumnRenamed("item_id", "_item")
    return rows.join(totals, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")


def _whole_items(benchmark: DataFrame, windows: DataFrame, options: Options) -> DataFrame:
    """hash and size (of the first words, a window's at most), item_id and literal of the items without a window."""
    met = windows.select(F.col("item_id").alias("_item")).distinct()
    items = _literal(_items(benchmark)).join(met, F.col("item_id").eqNullSafe(F.col("_item")), "left_anti")
    items = items.where(F.exists("literal", lambda w: w.rlike(WORDLIKE))).withColumn("size", F.least(F.lit(options.window), F.size("literal")))
    hashed = F.lit(None).cast("long")
    for n in range(1, options.window + 1):
        hashed = F.when(F.col("size") == n, F.xxhash64(*[F.xxhash64(F.get("literal", F.lit(k))) for k in range(n)])).otherwise(hashed)
    return items.withColumn("hash", hashed)


def _whole_leaks(docs: DataFrame, items: DataFrame, options: Options) -> DataFrame | None:
    """doc_id and item_id where a document holds all words of an item without a window."""
    wanted = _wanted(items, options)
    if wanted is None:
        return None
    longest = items.agg(F.max(F.size("literal"))).first()[0]
    side = F.broadcast(items) if wanted.few else items
    df = _literal(common.texts(docs)).withColumn("wh", F.transform("literal", lambda w: F.xxhash64(w)))
    df = _met(df, wanted).select("doc_id", F.col("met.h").alias("h"), F.col("met.n").alias("doc_size"), F.slice("literal", F.col("met.i") + 1, longest).alias("here"))
    met = df.join(side, (F.col("h") == F.col("hash")) & (F.col("doc_size") == F.col("size")) & (F.slice("here", F.lit(1), F.size("literal")) == F.col("literal")))
    return met.select("doc_id", "item_id").distinct()


@dataclass(frozen=True)
class Wanted:
    """Sizes of the windows asked for, and a flag for each remainder of their hashes."""

    sizes: tuple[int, ...]
    flags: bytes
    few: bool

    def may_hold(self, h: Column) -> Column:
        at = F.pmod(h, F.lit(len(self.flags))).cast("int") + 1
        return F.substring(F.lit(self.flags), at, F.lit(1)) == F.lit(b"\x01")


def _wanted(windows: DataFrame, options: Options) -> Wanted | None:
    """Only remainders reach the driver: at most as many as there are flags."""
    sizes = tuple(sorted(r["size"] for r in windows.select("size").distinct().collect()))
    if not sizes:
        return None
    n = windows.count()
    total = 1 << min(24, max(12, (options.flags * n - 1).bit_length()))
    flags = bytearray(total)
    for batch in windows.select(F.pmod("hash", F.lit(total)).cast("int").alias("k")).distinct().toArrow().to_batches():
        for k in batch.column(0).to_pylist():
            flags[k] = 1
    return Wanted(sizes, bytes(flags), n <= options.broadcast_windows)


def _met(df: DataFrame, wanted: Wanted) -> DataFrame:
    """Drops wh, the words' hashes, and adds met: h, i and n of each window that may
    be wanted, a row each; the join decides."""

    def met_of(size: int) -> Column:
        marked = F.transform(_window_hashes("wh", size), lambda h, i: F.struct(h.alias("h"), i.alias("i"), F.lit(size).alias("n")))
        return F.coalesce(F.filter(marked, lambda x: wanted.may_hold(x["h"])), F.array().cast("array<struct<h:bigint,i:int,n:int>>"))

    # A condition that isn't deterministic keeps the filter below from being
    # pushed down, which would copy the whole chain of expressions into it.
    df = df.withColumn("met", F.when(F.monotonically_increasing_id() >= 0, F.concat(*map(met_of, wanted.sizes))))
    return df.drop("wh").where(F.size("met") > 0).withColumn("met", F.explode("met"))


def _hits(docs: DataFrame, wanted: Wanted, names: list[str]) -> DataFrame:
    """doc_id, h, size, doc_at, doc_shape and doc_plain of the documents' windows
    that may be wanted: one scan for all sizes."""
    df = _tokens(common.texts(docs), names).withColumn("wh", F.transform("shape", lambda w: F.xxhash64(w)))
    df = _met(df, wanted)
    cut = lambda c: F.slice(c, F.col("met.i") + 1, F.col("met.n"))
    return df.select("doc_id", F.col("met.h").alias("h"), F.col("met.n").alias("doc_size"), F.col("met.i").alias("doc_at"), cut("shape").alias("doc_shape"), cut("plain").alias("doc_plain"))


def _verbatim_runs(met: DataFrame) -> DataFrame:
    """doc_id, item_id and run, the words under windows met word for word that
    overlap or touch in one alignment."""
    line = Window.partitionBy("doc_id", "item_id", "offset").orderBy("at")
    rows = met.where("exact").select("doc_id", "item_id", "offset", "at", "size").distinct()
    rows = rows.withColumn("new", F.coalesce((F.col("at") > F.lag(F.col("at") + F.col("size")).over(line)).cast("long"), F.lit(0)))
    rows = rows.withColumn("island", F.sum("new").over(line))
    return rows.groupBy("doc_id", "item_id", "offset", "island").agg((F.max(F.col("at") + F.col("size")) - F.min("at")).alias("run"))


def leaks(docs: DataFrame, benchmark: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, item_id, n_windows (met), item_windows, n_exact (windows met word
    for word) of every leaked item."""
    names = benchmark_names(benchmark)
    windows = common.materialize(benchmark_windows(benchmark, names, options), "benchmark")
    whole = _whole_leaks(docs, common.materialize(_whole_items(benchmark, windows, options), "benchmark-whole"), options)
    one = F.lit(1).cast("long")
    whole = whole.withColumns({"n_windows": one, "item_windows": one, "n_exact": one}) if whole is not None else None
    wanted, found = _wanted(windows, options), None
    if wanted is not None:
        hits = _hits(docs, wanted, names)
        side = F.broadcast(windows) if wanted.few else windows
        met = hits.join(side, (F.col("h") == F.col("hash")) & (F.col("doc_size") == F.col("size")) & (F.col("doc_shape") == F.col("shape")))
        found = met.select(
            "doc_id", "item_id", "at", "n_windows", (F.col("doc_at") - F.col("at")).alias("offset"), (F.col("doc_plain") == F.col("plain")).alias("exact"), "size",
            F.filter(F.zip_with(F.arrays_zip("shape", "plain"), "doc_plain", lambda a, b: F.struct(a["shape"].alias("shape"), a["plain"].alias("item"), b.alias("doc"))), lambda x: x["shape"].startswith("<")).alias("slots"),
        )
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    if found is None and whole is not None:
        return whole
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {item}, n_windows long, item_windows long, n_exact long")
    found = common.materialize(found, "template-hits")
    key = ["doc_id", "item_id", "offset"]
    slots = found.select(*key, F.explode("slots").alias("x")).groupBy(*key, "x.shape", "x.item").agg(F.min("x.doc").alias("a"), F.max("x.doc").alias("b"))
    mixed = slots.where(F.col("a") != F.col("b")).select(*key).distinct().withColumns({"bad": F.lit(True)})
    good = found.alias("f").join(mixed.alias("m"), F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("f.item_id").eqNullSafe(F.col("m.item_id")) & (F.col("f.offset") == F.col("m.offset")), "left_anti")
    runs = _verbatim_runs(good).where(F.col("run") >= options.run).select(F.col("doc_id").alias("_doc"), F.col("item_id").alias("_item")).distinct().withColumn("verbatim", F.lit(True))
    each = good.groupBy("doc_id", "item_id", "at").agg(F.max("n_windows").alias("item_windows"), F.max(F.col("exact").cast("long")).alias("exact"))
    out = each.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.sum("exact").alias("n_exact"))
    out = out.join(runs, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("item_id").eqNullSafe(F.col("_item")), "left")
    out = out.where((F.col("n_windows") >= options.coverage * F.col("item_windows")) | F.col("verbatim")).drop("_doc", "_item", "verbatim")
    return out if whole is None else out.unionByName(whole)


def clean(docs: DataFrame, benchmark: DataFrame, options: Options = Options()) -> DataFrame:
    """The documents without a leaked item, with their own columns."""
    bad = leaks(docs, benchmark, options).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
