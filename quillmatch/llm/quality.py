"""Quality rules by distribution divergence (DataFrame functions only).

Each document gets two histograms: character classes, and the common words of
its language (plus one bin for all other words). They are compared with the
reference of the document's language by the Jensen-Shannon distance (base 2, in
[0, 1]). The references are means over all documents of that language which
pass the base rules, held as whole numbers so that the order of summation
cannot change them. A document is rejected when a distance exceeds its limit;
the limit widens by ``slack / sqrt(n_words)``, as short histograms are noisy,
and under ``min_words`` words the method gives no verdict (the document stays
unless the base rules reject it).

Defined cases: null text counts as empty (0 words: base rules reject it). A
null or unknown language has no list of common words, so only its character
classes are compared, against the reference of documents with that same
language value. Very long texts are read whole: all products are 64-bit. A repeated row is judged as often as it occurs. An empty table
gives an empty result. Columns other than doc_id, text and lang are not read by
``profile`` and are passed through unchanged by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Common words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was as with be by are this at from".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec ce".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
#: Character classes, taken in this order; "other" is what remains.
CLASSES = {
    "lower": "[a-z]+",
    "space": "[ \\x09-\\x0D]+",
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "symbol": "[#*$%&|<>]+",
    "punct": "[\\x21-\\x7E]+",
}
UNIT = 1_000_000


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_class_distance: float = 0.14
    max_word_distance: float = 0.25
    slack: float = 0.6
    #: Languages beyond this number are joined by a shuffle instead of a broadcast.
    broadcast_languages: int = 1000


def _stages(df: DataFrame) -> DataFrame:
    """Base figures and histograms; each step is a projection of its own."""
    word_bins = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = sorted({w for v in COMMON_WORDS.values() for w in v})
    df = df.withColumns({
        "words": F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != ""),
        "filled": F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")),
        "left": F.col("text"),
        "n_all": F.length("text").cast("long"),
    }).drop("text")
    for name, pattern in CLASSES.items():
        df = df.withColumn("next", F.regexp_replace("left", pattern, ""))
        df = df.withColumn(f"n_{name}", (F.length("left") - F.length("next")).cast("long")).drop("left").withColumnRenamed("next", "left")
    df = df.withColumns({
        "n_words": F.size("words").cast("long"),
        "n_other": F.length("left").cast("long"),
        "n_dup_lines": (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long"),
        "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        "listed": F.transform(F.filter("words", lambda w: F.lower(w).isin(every)), F.lower),
        "bins": word_bins[F.col("lang")],
    }).drop("words", "filled", "left")
    df = df.withColumn("windows", F.when(
        F.col("n_words") >= 8,
        F.transform(F.sequence(F.lit(0), (F.col("n_words") - 8).cast("int")), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(8)])),
    )).drop("hashes")
    df = df.withColumn("order", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    )).drop("windows")
    df = df.withColumn("twice", F.sort_array(F.transform(
        F.filter("order", lambda x, i: F.coalesce(F.get("order", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("order", i + 1)["h"] == x["h"], F.lit(False))),
        lambda x: x["i"],
    ))).drop("order")
    covered = F.aggregate(
        F.transform("twice", lambda p, i: F.least(F.lit(8), F.coalesce(F.get("twice", i + 1) - p, F.lit(8)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    counts = [F.col(f"n_{c}") for c in (*CLASSES, "other")]
    return df.select(
        *[c for c in df.columns if c in ("doc_id", "lang")],
        "n_words",
        (F.col("n_all") - F.col("n_space")).alias("word_chars"),
        F.col("n_symbol").alias("n_symbols"),
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(F.col("n_all") > 0, F.transform(F.array(*counts), lambda c: F.floor(c * UNIT / F.col("n_all")))).alias("classes"),
        F.when(F.col("n_words") > 0, F.transform(F.transform("bins", lambda w: F.size(F.filter("listed", lambda x: x == w)).cast("long")), lambda c: F.floor(c * UNIT / F.col("n_words")))).alias("listed"),
    )


def _with_rest(bins: Column) -> Column:
    """The bins as shares, and the share of all else."""
    total = F.aggregate(bins, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.concat(bins, F.array(F.greatest(F.lit(0).cast("long"), F.lit(UNIT).cast("long") - total))), lambda x: x / UNIT)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of shares; null if one is null."""
    def part(a, b):
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def profile(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document: base figures, the two distances and the verdict."""
    df = common.materialize(_stages(common.texts(docs, "lang")), "quality")
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    n_bins = max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(F.get(c, F.lit(k))).alias(f"{c}_{k}") for c, n in (("classes", len(CLASSES) + 1), ("listed", n_bins)) for k in range(n)]
    sound = df.where(~F.col("base_failed")).groupBy("lang").agg(F.count("*").alias("n"), *sums)
    mean = lambda c, n: F.array_compact(F.array(*[F.floor(F.col(f"{c}_{k}") / F.col("n")) for k in range(n)]))
    reference = sound.select(
        F.col("lang").alias("ref_lang"),
        mean("classes", len(CLASSES) + 1).alias("ref_classes"),
        F.when(F.col("listed_0").isNotNull(), mean("listed", n_bins)).alias("ref_listed"),
    )
    reference = common.materialize(reference, "quality-reference")
    if reference.count() <= limits.broadcast_languages:
        reference = F.broadcast(reference)
    df = df.join(reference, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    wider = F.lit(limits.slack) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    df = df.withColumns({
        "class_distance": js_distance(F.transform("classes", lambda x: x / UNIT), F.transform("ref_classes", lambda x: x / UNIT)),
        "word_distance": js_distance(_with_rest(F.col("listed")), _with_rest(F.col("ref_listed"))),
    })
    strange = (F.col("n_words") >= limits.min_words) & (
        F.coalesce(F.col("class_distance") > limits.max_class_distance + wider, F.lit(False))
        | F.coalesce(F.col("word_distance") > limits.max_word_distance + wider, F.lit(False))
    )
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~strange).alias("kept"), "class_distance", "word_distance",
    )


def keep(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that pass, with their own columns. Rows that share a
    doc_id pass together only if each of them does."""
    bad = profile(docs, limits).where(~F.col("kept")).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile(common.table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})
