"""Known results of the metric functions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmatch.functions import counters, grams, sequence, survey, text, tree
from quillmatch.operators import report


def one(spark, column, **values):
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def counts(d):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv]).cast("map<string,int>") if d else F.create_map().cast("map<string,int>")


@pytest.mark.parametrize(("a", "b", "expected"), [
    ({"a": 2, "b": 1, "c": 5, "d": 7}, {"a": 10, "c": 8, "e": 2, "f": 12}, 0.175),
    ({"USub": 3, "Mor": 3, "Der": 5}, {"USub": 5, "Mor": 5, "Ker": 5}, 0.3),
    ({}, {"a": 1}, 0.0), ({}, {}, 1.0),
])
def test_counter_metric(spark, a, b, expected):
    assert one(spark, counters.counter_metric("a", "b"), a=counts(a), b=counts(b)) == pytest.approx(expected)


def array(xs, kind="int"):
    return F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")


def test_ngrams_and_jaccard(spark):
    assert one(spark, grams.ngrams("t", 3), t=array([1, 2, 3, 4])) == [[1, 2, 3], [2, 3, 4]]
    assert one(spark, grams.ngrams("t", 3), t=array([1, 2])) == []
    assert one(spark, grams.unique_ngrams("t", 2), t=array([1, 1, 1])) == [[1, 1]]
    assert one(spark, grams.jaccard("a", "b", 2), a=array([1, 2, 3, 4]), b=array([2, 3, 4, 5])) == pytest.approx(0.5)
    assert one(spark, grams.jaccard("a", "b", 3), a=array([1]), b=array([1])) == 0.0


@pytest.mark.parametrize(("hashes", "expected"), [
    ([1, 2, 3, 4, 5], [1, 3, 5]), ([3, 4, 7, 8, 15, 3], [3, 7, 15]), ([1, 2, 3, 7, 4, 4, 5, 6], [1, 7, 5]), ([9], None),
])
def test_imprints(spark, hashes, expected):
    assert one(spark, grams.imprints("h"), h=array(hashes)) == expected


@pytest.mark.parametrize(("a", "b", "expected"), [
    ([], [], (0, 1.0)), (["+", "-", "="], [], (0, 0.0)), (["+", "-", "=", "*"], ["+", "-", "=", "/"], (0, 0.6)), (["+", "-", "=", "/"], ["*", "/", "+", "-"], None),
])
def test_operator_shift(spark, a, b, expected):
    shift, value = sequence.operator_shift(a, b)
    got = one(spark, sequence.op_shift("a", "b"), a=array(a, "string"), b=array(b, "string"))
    assert (got["shift"], got["value"]) == (shift, pytest.approx(value))
    if expected:
        assert (shift, value) == (expected[0], pytest.approx(expected[1]))


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_sequences_against_plain_versions(a, b):
    assert sequence.lcs(a, b) == plain_lcs(a, b)
    assert sequence.greedy_tiles(a, b, 2) == plain_tiles(a, b, 2)


def plain_tiles(a, b, least):
    """The rule as it is stated: longest runs first, in order of place; a tile is
    taken if its ends are free in both."""
    ma, mb = [], []
    while True:
        runs = {}
        for p in range(len(a)):
            for t in range(len(b)):
                k = 0
                while p + k < len(a) and t + k < len(b) and a[p + k] == b[t + k] and p + k not in ma and t + k not in mb:
                    k += 1
                if k >= least:
                    runs.setdefault(k, []).append((p, t))
        if not runs:
            return ma, mb
        k = max(runs)
        for p, t in runs[k]:
            if not (sequence.is_occupied(ma, p, k) or sequence.is_occupied(mb, t, k)):
                ma += range(p, p + k)
                mb += range(t, t + k)
        if k == least:
            return ma, mb


def test_edit_distance():
    assert sequence.levenshtein("cat", "dog") == 3 and sequence.levenshtein_similarity("cat", "dog") == 0
    assert sequence.levenshtein_similarity([1, 2, 3, 4, 5], [1, 2, 3, 7, 8]) == pytest.approx(0.6)
    assert sequence.levenshtein_similarity([], []) == 1.0


GOLDEN = [
    ([1, 2, 3, 3, 2, 3, 4, 3, 3, 4, 2], [1, 2, 2, 3, 4, 5, 4, 4, 4, 1, 2, 3, 3, 3, 2], (6, 22), [[(5, 15), (5, 12)]]),
    ([1, 2, 3, 2, 3, 4, 3, 4, 2, 3, 4, 3, 4, 2, 3], [1, 2, 3, 2, 3, 4, 3, 4, 5, 6, 5, 4, 2, 3, 4, 3, 4, 5, 4, 5], (14, 23), [[(13, 22)]]),
    ([], list(range(1, 34)), (1, 34), []),
]


@pytest.mark.parametrize(("a", "b", "ratio", "matrix"), GOLDEN)
def test_struct_compare(a, b, ratio, matrix):
    assert tree.struct_compare(a, b) == (ratio, matrix)


def test_tree_helpers():
    assert tree.children_indexes([1, 2, 1, 2, 2]) == [0, 2]
    assert tree.best_cell([[(1, 2), (2, 3)], [(0, 0), (2, 3)]]) == (0, 1)
    assert tree.best_cell([[(0, 0)]]) == (0, 0)
    assert tree.assign([[(1, 2), (1, 1)], [(1, 1), (1, 4)]])[0] == (3, 3)
    assert tree.unmatched_size([(0, 1), (0,), (0, 1, 1)], {0}) == 4


def test_structure_hash(spark):
    empty = F.array().cast("array<struct<depth:int,uid:int>>")
    assert one(spark, tree.structure_sha256("s"), s=empty) == "4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945"


def test_python_rounding(spark):
    rows = spark.createDataFrame([(80.625,), (2.675,), (None,)], "x double").select(text.python_round()("x").alias("r")).collect()
    assert [r["r"] for r in rows] == [80.62, 2.67, None]


def test_texts(spark):
    assert one(spark, text.parse_list_text("x"), x=F.lit("['a[1]', 'b[2]']")) == ["a[1]", "b[2]"]
    assert one(spark, text.parse_list_text("x"), x=F.lit("[]")) == []
    assert one(spark, text.list_text("x"), x=array(["a", "b"], "string")) == "['a', 'b']"
    assert one(spark, text.percent_text("x"), x=F.lit(0.5)) == "50.00%"
    assert one(spark, text.host_url("x")["path"], x=F.lit("https://github.com/o/r/blob/main/src/a.py")) == "src/a.py"
    assert one(spark, text.host_url("x"), x=F.lit("https://example.com/o/r")) is None
    lengths = spark.createDataFrame([("a b\n\nc\n",)], "c string").select(*[v.alias(k) for k, v in text.text_lengths("c").items()]).first()
    assert tuple(lengths) == (7, 3, 3)


def test_report_figures(spark):
    assert report.percent_matrix([[[1, 2], [1, 3], [3, 4]], [[1, 8], [1, 4], [3, 5]]]) == [[50.0, 33.33, 75.0], [12.5, 25.0, 60.0]]
    m = [[10.0, 20.0, 30.0, 40.0, 50.0], [72.0, 74.0, 3.0, 80.0, 5.0], [70.0, 75.0, 80.0, 85.0, 90.0], [40.0, 30.0, 20.0, 10.0, 10.0]]
    one_, two = ["foo", "bar", "foobar", "barfoo"], ["func_name", "sum", "mult", "div", "sub"]
    assert report.same_functions(one_, two, m, 70, True, 2) == {
        "foo": [("sub", 50.0)], "bar": [("div", 80.0), ("sum", 74.0)], "foobar": [("sub", 90.0), ("div", 85.0)], "barfoo": [("func_name", 40.0)]}
    assert report.same_functions(one_, two, m, 70, False, 2) == {"foo": [], "bar": [("div", 80.0), ("sum", 74.0)], "foobar": [("sub", 90.0), ("div", 85.0)], "barfoo": []}
    cells = lambda *percents: [(f"h{k}", p) for k, p in enumerate(percents)]
    # Of equal weakest ones the earliest gives way; equal percents are no reason to.
    assert report.most_similar(cells(70.0, 70.0, 90.0, 80.0), 65, n=3) == [("h2", 90.0), ("h3", 80.0), ("h1", 70.0)]
    assert report.most_similar(cells(70.0, 70.0, 70.0, 70.0), 65, n=3) == [("h0", 70.0), ("h1", 70.0), ("h2", 70.0)]
    assert report.most_similar(cells(10.0, 80.0, 85.0, 90.0, 85.0), 65, n=3) == [("h3", 90.0), ("h2", 85.0), ("h4", 85.0)]
    assert report.most_similar(cells(10.0, 12.0, 12.0, 70.0), 65, n=3) == [("h3", 70.0), ("h1", 12.0)]
    assert report.most_similar([("f", 70.0), ("g", 80.0), ("f", 75.0)], 65, n=3) == [("g", 80.0), ("f", 75.0)]
    assert report.most_similar(cells(10.0, 64.9), 65, below=False) == [] == report.most_similar([], 65)
    infos = spark.createDataFrame([("a.py", "c.py", 0.15), ("b.py", "d.py", 0.1), ("a.py", "e.py", 0.3)], "first_path string, second_path string, weighted_average double")
    a, b = report.unique_paths(infos)
    assert report.general_total(infos, a, b).first()[0] == 20.0
    assert report.general_total(infos, b, a).first()[0] == 18.33
    assert report.general_total(infos, a.limit(0), b).first()[0] == 0.0


def test_survey(spark):
    rows = spark.createDataFrame([(i, 2.0 * i + 1) for i in range(30)], "x int, y double")
    assert survey.trend(rows, "x", "y") == pytest.approx([2.0, 1.0])
    assert tuple(survey.linear_trend(rows, "x", "y").first()) == pytest.approx((2.0, 1.0))
    assert tuple(survey.linear_trend(rows.limit(1), "x", "y").first()) == (None, None)
    cubes = rows.select("x", (F.col("x") * F.col("x") * F.col("x") * 3.0).alias("y"), (F.col("x") % 2).alias("k"))
    assert sorted(map(tuple, survey.power_trend(cubes, "x", "y", 3, "k").collect())) == [(0, pytest.approx(3.0)), (1, pytest.approx(3.0))]
    rolled = survey.rolling_mean(rows, "x", "y").orderBy("x").collect()
    assert rolled[18]["rolling_mean"] is None and rolled[19]["rolling_mean"] == pytest.approx(20.0)
    kept = survey.keep_last(spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "i int, k int"), "k", "i")
    assert sorted(r["i"] for r in kept.collect()) == [2, 3]


def test_many_trees_against_a_plain_recursion():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([1] + [1] * 0 for _ in range(2))
        for t in (a, b):
            for _ in range(rng.randrange(12)):
                t.append(rng.randint(1, t[-1] + 1))
        assert tree.struct_compare(a, b)[0] == plain_struct(a, b)


def plain_struct(a, b):
    if not a or not b:
        return (1, 1) if not a and not b else (1, len(a) + len(b) + 1)

    def cut(t):
        at = [k for k, d in enumerate(t) if d == t[0]]
        return [t[i:j] for i, j in zip(at, at[1:] + [len(t)])]

    x, y = cut(a), cut(b)
    cells = {(i, j): plain_struct(p[1:], q[1:]) for i, p in enumerate(x) for j, q in enumerate(y)}
    num = den = 1
    rows, cols = set(range(len(x))), set(range(len(y)))
    while rows and cols:
        i, j = max(((i, j) for i in sorted(rows) for j in sorted(cols)), key=lambda c: cells[c][0] / cells[c][1])
        num, den = num + cells[i, j][0], den + cells[i, j][1]
        rows.remove(i)
        cols.remove(j)
    return num, den + sum(len(x[i]) for i in rows) + sum(len(y[j]) for j in cols)
