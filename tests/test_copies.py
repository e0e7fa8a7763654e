"""Pairs of documents with copies, and with ids of any length, against brute force and the SQL."""

from itertools import combinations

import pytest

from quillmatch import queries

BODY = [f"word{k}" for k in range(40)]
TEXTS = [
    (3, " ".join(BODY)), (4, "  ".join(BODY).upper()), (11, " ".join(BODY)), (12, " ".join(BODY)), (7, " ".join([*BODY, "more,"])), (8, " ".join([*BODY, "More,"])),
    (20, "two words"), (21, "two words"), (22, "one"), (23, "one"), (24, None), (25, ""), (30, "in all 3 words"), (31, "in all 3 words"), (40, " ".join(f"other{k}" for k in range(30))),
]


def _tables(spark, path, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{path}/documents.parquet")
    db = pytest.importorskip("duckdb").connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return str(path), db


def _same(spark, name, path, db):
    got = queries.QUERIES[name](spark, path)
    rows = sorted(tuple(r) for r in got.collect())
    expected = db.execute(queries.ORACLE_SQL[name])
    assert got.columns == [d[0] for d in expected.description]
    expected = sorted(expected.fetchall())
    assert [r[:2] for r in rows] == [r[:2] for r in expected]
    assert rows == [pytest.approx(r) for r in expected]
    return [r[:2] for r in rows]


def _ids_of_any_length(spark, path, name):
    texts = [(1234567890121, " ".join(BODY)), (1234567890122, " ".join([*BODY, "a"])), (-5, " ".join([*BODY, "b"])), (7, " ".join([*BODY, "c"]))]
    assert _same(spark, name, *_tables(spark, path, texts)) == sorted(combinations(sorted(i for i, _ in texts), 2))


def _all_copies(spark, path, monkeypatch, name, n):
    monkeypatch.setattr(queries, "MEMBERS", 2)
    monkeypatch.setattr(queries, "SALTS", 1)
    grams = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, t in TEXTS for w in [(t or "").lower().split()]}
    expected = [(a, b) for a, b in combinations(sorted(grams), 2) if grams[a] & grams[b]]  # alike wherever they share anything
    found = _same(spark, name, *_tables(spark, path, TEXTS))
    assert found == expected and {(3, 4), (4, 12), (11, 12), (8, 11), (7, 8), (30, 31)} <= set(found)
    assert (20, 21) in found if n == 2 else (20, 21) not in found


def test_ids_of_any_length(spark, tmp_path):
    _ids_of_any_length(spark, tmp_path, "doc_fast_compare")


def test_all_copies_are_paired(spark, tmp_path, monkeypatch):
    _all_copies(spark, tmp_path, monkeypatch, "doc_fast_compare_all", 3)


def test_ids_of_any_length_by_bigrams(spark, tmp_path):
    _ids_of_any_length(spark, tmp_path, "doc_fast_compare_bigrams")


def test_all_copies_are_paired_by_bigrams(spark, tmp_path, monkeypatch):
    _all_copies(spark, tmp_path, monkeypatch, "doc_fast_compare_bigrams_all", 2)
