"""Every query of the subpackage with SQL gives what DuckDB gives for that SQL."""

import pytest

from peregrin.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    got, want = queries.queries()[name](spark, DATA), con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted([tuple(str(r[c]) for c in columns) for r in got.collect()]) == sorted([tuple(str(r[i]) for i in at) for r in want.fetchall()])
