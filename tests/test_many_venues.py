"""Trips in cities of very many venues: as with all distances kept, and without them."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peregrin.operators import routing as RT
from peregrin.plans import trip as TP


def some_places(n, seed=4):
    rng = np.random.default_rng(seed)
    food = np.arange(n) >= 12
    return pd.DataFrame({"lat": 40 + rng.random(n) / 20, "lon": 2 + rng.random(n) / 20, "visit": 30 + rng.integers(0, 4, n) * 15, "open": 9, "close": 18 + rng.integers(0, 4, n), "category": np.where(food, "food", "museum")})


@pytest.mark.parametrize("hub", [None, (40.02, 2.01)])
@pytest.mark.parametrize("mode", ["walking", "hybrid"])
def test_distances_on_demand_give_the_same_days(monkeypatch, hub, mode):
    places = some_places(200)
    plans = []
    for kept in (1024, 10):
        monkeypatch.setattr(RT, "KEPT_PLACES", kept)
        trip = RT.Trip(places, mode, hub)
        days = RT.plan_days(trip, {0: list(range(6)), 1: list(range(6, 12))}, 480, True, list(range(12, 200)), 2)
        plans.append([(d.stops, d.times, d.km, d.minutes) for d in days])
    assert plans[0] == plans[1] and any(s >= 12 for d in plans[0] for s in d[0])


def test_a_city_of_venues_needs_no_matrix_of_them():
    places = some_places(6000)
    tracemalloc.start()
    days = RT.plan_days(RT.Trip(places, "hybrid", (40.02, 2.01)), {0: list(range(12))}, 480, True, list(range(12, 6000)), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert days[0].stops and peak < 100e6


def test_copies_of_venues_do_not_change_trips(spark, monkeypatch):
    rng = np.random.default_rng(2)
    spots = [(40 + rng.random() / 20, 2 + rng.random() / 20) for _ in range(30)]
    rows = [(i, 1, *spots[i % 30], "food" if i % 30 > 8 else "museum", 30 + i % 30 % 4 * 15, 9, 20) for i in range(900)]
    places = spark.createDataFrame(rows, "id long, destination_id int, lat double, lon double, category string, visit int, open int, close int")
    sights = places.where("id < 14").select(F.lit(5).cast("long").alias("trip_id"), "id", "lat", "lon", "category", "visit", "open", "close", F.lit("sight").alias("role"))
    kinds = spark.createDataFrame([(5, 1, 2, 480.0, "hybrid")], "trip_id long, destination_id int, days int, day_budget double, mode string")
    centres = spark.createDataFrame([(1, 40.02, 2.02)], "destination_id int, hub_lat double, hub_lon double")
    got = sorted(map(tuple, TP.route_trips(kinds, sights, places, centres).collect()))
    monkeypatch.setattr(TP, "useful_venues", lambda food, n: food)
    assert got and got == sorted(map(tuple, TP.route_trips(kinds, sights, places, centres, near_venues=False).collect()))
