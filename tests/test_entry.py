"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_each_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80
