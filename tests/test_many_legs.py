"""Legs between stops that share points, against all pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from peregrin.operators import routing as RT


def test_legs_of_stops_that_share_points_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(RT, "SPOT", 3)
    rows = [(t, 100 * t + i, 40 + i % 4 / 100, 2 + i % 4 / 50) for t in (1, 2) for i in range(24)] + [(1, 500, None, 2.0), (3, 900, 40.0, 2.0)]
    stops = spark.createDataFrame(rows, "trip_id long, id long, lat double, lon double")
    mode = F.when(F.col("trip_id") == 1, "hybrid").otherwise("walking")
    got = RT.legs(stops, mode, digits=6).collect()
    none = spark.createDataFrame([], "trip_id long, src long, dst long, profile string, km double, minutes double")
    want = RT.legs(stops, mode, none, digits=6).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 25 * 24 + 24 * 23
    assert {r.minutes is None for r in got if 500 in (r.src, r.dst)} == {r.minutes is None for r in want if 500 in (r.src, r.dst)}


def test_a_trip_of_legs_is_dealt_into_many_groups(spark):
    stops = spark.range(400).select(F.lit(1).cast("long").alias("trip_id"), "id", (F.lit(40.0) + F.col("id") / 1e4).alias("lat"), F.lit(2.0).alias("lon"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = RT.legs(stops, F.lit("walking")).groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks > 1
