"""Mixing documents to target domain weights (DataFrame functions only).

Domains are the four combinations of the labels: clean, low (quality 0), toxic,
and both. For each of the two labels a naive Bayes classifier is fitted on a
bounded sample of labelled rows, from the number of distinct words present out
of those that stand out with the label, and the classes of three character
shares. The products give every document posteriors over the domains (soft
memberships), held in steps of 0.01.

Rates r >= 0 minimise the squared gap between expected domain token totals
``T_d = sum r_i n_i q_id`` and the targets, by projected gradient steps
``r_i <- max(0, r_i - sum_d q_id (T_d - t_d) / M_d)`` from r = 1 (M_d is the
domain's mass at r = 1; the step is preconditioned by 1 / n_i). A rate thus
depends on the posteriors alone, so rows are summed into cells of equal
posteriors first: at most 176,851 cells for four domains in steps of 0.01,
whatever the input. Each step is an aggregation over the cells; only the four
gradients reach the driver. Sums are exact decimals, so results do not depend
on the order of rows.

Default targets: a domain keeps ``ratio[d]`` times the clean domain's tokens, or
all it has if that is less.

Defined cases: null text counts as empty (0 tokens; posteriors from the priors).
Labels with a null in any column are not used; without usable labels every
document is clean and all rates are 1. Very long texts are read whole. Repeated
rows get the same rate. An
empty table gives an empty result. ``apply`` passes all columns through.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DOMAINS = ("clean", "low", "toxic", "low_toxic")
STEPS = 100


@dataclass(frozen=True)
class Options:
    #: Bound of the labelled sample the classifier is fitted on (documented parameter).
    max_labelled: int = 10_000
    #: Words of a label: those that exceed independence most, by deviations and by log odds.
    max_words: int = 200
    min_deviation: float = 6.0
    min_lift: float = 1.5
    #: Targets as parts of the clean domain's tokens.
    ratio: dict = field(default_factory=lambda: {"clean": 1.0, "low": 0.05, "toxic": 0.02, "low_toxic": 0.005})
    iterations: int = 60
    tolerance: float = 1e-6
    seed: int = 42


@dataclass(frozen=True)
class Factor:
    """One label's naive Bayes: its words, and log odds for classes of features."""

    prior: float = -50.0
    words: tuple = ()
    odds: tuple = ()


@dataclass(frozen=True)
class Model:
    low: Factor = Factor()
    toxic: Factor = Factor()


def _features(df: DataFrame) -> DataFrame:
    """Adds words (distinct, lower-case), n_tokens and shares (three classes 0..7)."""
    df = df.withColumn("bare", F.regexp_replace("text", "[a-z \\x09-\\x0D]+", ""))
    df = df.withColumn("marks", F.regexp_replace("bare", "[A-Z\\x80-\\x{10FFFF}]+", ""))
    df = df.withColumn("odd", F.regexp_replace("marks", "[.,;:'\"?()0-9-]+", ""))
    chars = F.greatest(F.length("text"), F.lit(1))
    share = lambda c: F.least(F.lit(7), F.floor(F.log2(1 + 1000.0 * F.length(c) / chars) * 0.8)).cast("int")
    return df.withColumns({
        "bag": F.split(F.lower("text"), "[ \\x09-\\x0D.,;:!?|&%$#*<>()\"]+"),
        "shares": F.array(share("bare"), share("marks"), share("odd")),
    }).drop("bare", "marks", "odd")


def _classes(words: tuple) -> Column:
    """Classes of the features: the three shares, then the number of words found (0..4)."""
    found = F.size(F.filter("found", lambda w: w.isin(list(words)))) if words else F.lit(0)
    return F.concat("shares", F.array(F.least(F.lit(4), found)))


def _fit_factor(seen: DataFrame, label: str, options: Options) -> Factor:
    """Words that stand out in the rows with the label, then the odds of all classes."""
    yes, every = (x or 0 for x in seen.agg(F.sum(label), F.count("*")).first())
    if not yes or yes == every:
        return Factor(-50.0 if not yes else 50.0)
    n = F.count("*")
    words = seen.select(label, F.explode("bag").alias("w")).where(F.col("w") != "").groupBy("w").agg(F.sum(label).alias("n1"), n.alias("n"))
    expected = F.col("n") * (yes / every)
    lift = F.log((F.col("n1") + 0.5) / (yes + 1)) - F.log((F.col("n") - F.col("n1") + 0.5) / (every - yes + 1))
    best = (
        words.where(F.col("n1") >= 5)
        .withColumns({"z": (F.col("n1") - expected) / F.sqrt(expected + 1), "lift": lift})
        .where((F.col("z") >= options.min_deviation) & (F.col("lift") >= options.min_lift))
        .orderBy(F.desc("z"), "w").limit(options.max_words)
    )
    lexicon = tuple(r["w"] for r in best.collect())  # at most max_words rows
    # Toxic text is told by its words alone.
    rows = seen.withColumn("found", F.col("bag"))
    rows = rows.select(label, F.posexplode(_classes(lexicon)).alias("k", "x")).where((F.col("k") == 3) | F.lit(label != "toxic"))
    odds = rows.groupBy("k", "x").agg(F.sum(label).alias("n1"), n.alias("n")).orderBy("k", "x").collect()  # at most 29 rows
    weight = lambda r: log((r["n1"] + 0.5) / (yes + 4)) - log((r["n"] - r["n1"] + 0.5) / (every - yes + 4))
    return Factor(log((yes + 0.5) / (every - yes + 0.5)), lexicon, tuple(((r["k"], r["x"]), weight(r)) for r in odds))


def fit(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> Model:
    """The classifier, from at most about ``max_labelled`` labelled rows."""
    usable = labels.where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)").groupBy("doc_id").agg((1 - F.max("quality")).alias("low"), F.max("toxic").alias("toxic")).withColumnRenamed("doc_id", "_id")
    n = usable.count()
    if n > options.max_labelled:
        part = int(options.max_labelled / n * (1 << 20))
        usable = usable.where(F.pmod(F.xxhash64("_id", F.lit(options.seed)), F.lit(1 << 20)) < part)
    # About max_labelled rows: a bound that holds for any input.
    seen = common.texts(docs).join(F.broadcast(usable), F.col("doc_id") == F.col("_id"))
    seen = common.materialize(_features(seen).select("low", "toxic", "shares", F.array_distinct("bag").alias("bag")), "labelled")
    return Model(_fit_factor(seen, "low", options), _fit_factor(seen, "toxic", options))


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, th (a hash of the text), n_tokens and k: the posteriors of all
    domains but the first in steps of 0.01."""
    df = _features(common.texts(docs))
    lexicon = sorted({*model.low.words, *model.toxic.words})
    df = df.select(
        "doc_id", F.xxhash64("text").alias("th"), "shares",
        F.size(F.filter("bag", lambda w: w != "")).cast("long").alias("n_tokens"),
        (F.array_distinct(F.filter("bag", lambda w: w.isin(lexicon))) if lexicon else F.array().cast("array<string>")).alias("found"),
    )
    # The narrow rows are written once; what follows reads them only.
    df = common.materialize(df, "mixing")

    def chance(factor: Factor) -> Column:
        logit = F.lit(factor.prior)
        if factor.odds:
            table = F.create_map(*[x for (k, c), w in factor.odds for x in (F.lit(100 * k + c), F.lit(w))])
            logit = logit + F.aggregate(
                F.transform(_classes(factor.words), lambda c, k: F.coalesce(table[100 * k + c], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x
            )
        return 1 / (1 + F.exp(-logit))

    df = df.withColumns({"low": chance(model.low), "toxic": chance(model.toxic)})
    low, toxic = F.col("low"), F.col("toxic")
    # Steps of the running sum: what one domain loses by rounding the next one gains.
    upto = [F.round(STEPS * x).cast("int") for x in (low * (1 - toxic), low * (1 - toxic) + (1 - low) * toxic, low + toxic - low * toxic)]
    k = [upto[0], upto[1] - upto[0], upto[2] - upto[1]]
    return df.select("doc_id", "th", "n_tokens", F.array(*k).alias("k"))


def _q() -> list[Column]:
    rest = [F.get("k", F.lit(d)) / STEPS for d in range(len(DOMAINS) - 1)]
    return [1 - sum(rest, F.lit(0.0)), *rest]


def _rate(steps: list[list[float]]) -> Column:
    """The rate after the gradient steps taken so far."""
    if not steps:
        return F.lit(1.0)
    q = _q()
    return F.aggregate(
        F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps]),
        F.lit(1.0),
        lambda r, s: F.greatest(F.lit(0.0), r - sum((q[d] * F.get(s, F.lit(d)) for d in range(len(q))), F.lit(0.0))),
    )


def default_targets(mass: list[float], options: Options) -> list[float]:
    return [min(m, options.ratio[d] * mass[0]) if i else m * options.ratio[d] for i, (d, m) in enumerate(zip(DOMAINS, mass))]


def fit_rates(members: DataFrame, targets: list[float] | None = None, options: Options = Options()) -> tuple[DataFrame, list[float], list[float]]:
    """(cells with their rate, targets, expected totals reached)."""
    cells = common.materialize(members.groupBy("k").agg(F.sum(F.col("n_tokens").cast("decimal(38,0)")).alias("n")), "cells")

    def totals(steps):
        q, r = _q(), _rate(steps)
        row = cells.agg(*[F.sum((F.col("n").cast("double") * r * x).cast("decimal(38,6)")).alias(f"t{d}") for d, x in enumerate(q)]).first()
        return [float(x or 0) for x in row]

    mass = totals([])
    want = default_targets(mass, options) if targets is None else list(targets)
    steps: list[list[float]] = []
    now, every = mass, sum(mass)
    for _ in range(options.iterations):
        gap = [a - b for a, b in zip(now, want)]
        if not every or max(map(abs, gap)) <= options.tolerance * every:
            break
        steps.append([g / m if m else 0.0 for g, m in zip(gap, mass)])
        now = totals(steps)
    return cells.select("k", _rate(steps).alias("rate")), want, now


def rates(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, th, n_tokens, the posteriors p_<domain>, rate and copies.

    copies is the rate rounded down or up by a hash of the row, so that its
    expectation is the rate."""
    members = common.materialize(posteriors(docs, fit(docs, labels, options)), "members")
    cells, _, _ = fit_rates(members, None, options)
    # At most 176,851 cells (three numbers that sum to 100 or less): a bound that holds for any input.
    out = members.join(F.broadcast(cells), "k")
    q = _q()
    draw = F.pmod(F.xxhash64("doc_id", "th", F.lit(options.seed)), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor(F.col("rate") + draw).cast("long")
    return out.select("doc_id", "th", "n_tokens", *[q[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", copies.alias("copies"))


def apply(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """The documents as often as their copies say, with their own columns."""
    i, h, n = (common.fresh(docs, c) for c in ("_id", "_th", "_copies"))
    drawn = rates(docs, labels, options).select(F.col("doc_id").alias(i), F.col("th").alias(h), F.col("copies").alias(n)).where(F.col(n) > 0).distinct()
    text = F.coalesce(docs["text"], F.lit(""))
    out = docs.join(drawn.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h)))
    out = out.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), n)))
    return out.select(*[docs[c] for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("th")
