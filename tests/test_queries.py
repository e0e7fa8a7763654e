"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

from quillmatch import queries

SF = os.environ.get("QUILLMATCH_TEST_TABLES", "/root/testdata/sf0.001")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v

    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in queries.ORACLE_SQL:
        assert got.columns
        return
    expected = db.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in expected.description]
    assert rows_of(got.columns, rows) == rows_of(columns, expected.fetchall())
