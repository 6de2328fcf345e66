"""Every query with SQL gives what DuckDB gives for that SQL; the others give rows of a stable shape."""

from __future__ import annotations

import math

import pytest

from peregrin.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def shown(value) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted([tuple(shown(r[c]) for c in columns) for r in got.collect()]) == sorted([tuple(shown(r[i]) for i in at) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0
