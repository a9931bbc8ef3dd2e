"""Every query of the catalogue gives the rows of its SQL."""

import math

import duckdb
import pytest

from gridtide.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, DATA), duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    ours = sorted((tuple(map(_plain, r)) for r in got.select(*columns).collect()), key=repr)
    theirs = sorted((tuple(map(_plain, r)) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()), key=repr)
    assert ours == theirs
    assert ours
