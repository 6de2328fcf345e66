"""Lines are judged by their text, and equal ones together."""

from __future__ import annotations

from peregrin.operators import prep as P


def test_a_line_is_judged_by_its_own_text(spark):
    rows = [(1, "Red Ring"), (1, "zzz"), (2, " red ring "), (3, "ri"), (4, ""), (5, None)]
    names = spark.createDataFrame([("ring",), ("a",), ("",)], "name string")
    got = P.fuzzy_matches(spark.createDataFrame(rows, "line_id long, line string"), names)
    assert sorted((r.line_id, r.line or "", r.matched) for r in got.collect()) == [(1, "Red Ring", True), (1, "zzz", False), (2, " red ring ", True), (3, "ri", True), (4, "", False), (5, "", False)]
