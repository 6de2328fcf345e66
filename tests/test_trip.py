"""Trip plans do the whole job: all users, all candidates, all days, all retrievers."""

from __future__ import annotations

from peregrin.operators import graph as G
from peregrin.plans import compare, demo as D, trip

DATA = "/root/testdata/sf0.001"


def test_every_user_gets_a_trip(spark):
    users = {r.user_id for r in spark.read.parquet(f"{DATA}/events.parquet").select("user_id").distinct().collect()}
    days, full, ids, tables, _ = trip.demo_plan(spark, DATA)
    assert {r.trip_id for r in full.collect()} == users and len(users) > 10
    assert {r.trip_id for r in trip.narrative(days, tables["places"], full).collect()} == users


def test_long_trips_get_all_their_candidates(spark):
    """Luxury Traveler: the text has no category word, so the archetype's places are the whole graph list."""
    requests = spark.createDataFrame([(1, "Luxury Traveler", 3, 20), (2, "Luxury Traveler", 3, 3)], "trip_id long, archetype string, destination_id int, days int")
    d = "/root/testdata/sf0.1"
    got = trip.candidate_places(requests, D.places(spark, d), D.hubs(spark, d), G.affinity_table(spark)).groupBy("trip_id").count().collect()
    assert {r.trip_id: r["count"] for r in got} == {1: 160, 2: 24}


def test_trips_have_the_days_they_ask_for(spark):
    """Budget Backpacker likes food best, so its candidates may all be food places; it gets a plan nevertheless."""
    d = "/root/testdata/sf0.01"
    asked = {1: 1, 2: 5, 3: 10}
    likes = dict(zip(trip.S.PREFERENCES, trip.PROFILES["Budget Backpacker"], strict=True))
    requests = spark.createDataFrame([(t, likes, 3, "2001-11", n) for t, n in asked.items()], "trip_id long, preferences map<string,double>, destination_id int, travel_month string, days int")
    days, full, _ = trip.plan_trips(requests, **trip.demo_tables(spark, d)[0])
    assert {r.archetype for r in full.collect()} == {"Budget Backpacker"}
    rows = days.collect()
    assert {t: len({r.day for r in rows if r.trip_id == t}) for t in asked} == asked
    assert len({(r.trip_id, r.id) for r in rows}) == len(rows)


def test_a_hybrid_plan_retrieves_by_vector_and_keyword(spark):
    d = "/root/testdata/sf0.01"
    requests = spark.createDataFrame([(1, "Nature & Adventure", 3, 3), (2, "Luxury Traveler", 3, 3)], "trip_id long, archetype string, destination_id int, days int")
    t, _ = trip.demo_tables(spark, d)
    args = requests, t["places"], t["hubs"], t["affinity"], t["documents"], t["vectors"], t["query_vectors"]
    ids = {c: {(r.trip_id, r.id) for r in trip.candidate_places(*args, c).collect()} for c in ("fusion", "hybrid", "standard")}
    with_vector, nature = {r.vec_id for r in t["vectors"].collect()}, {r.id for r in t["places"].where("category = 'nature'").collect()}
    here = {r.id for r in t["places"].where("destination_id = 3").collect()}
    found = {i for k, i in ids["hybrid"] if k == 2}
    assert found and found <= with_vector & here  # no word of the text stands in a place's, so vectors alone find them
    assert {i for k, i in ids["hybrid"] if k == 1} & nature - with_vector
    assert len({frozenset(x) for x in ids.values()}) == 3


def test_the_comparison_has_all_requests_and_retrievers(spark):
    requests = compare._requests(spark, DATA)
    lists = compare.R.document_search(requests, D.place_texts(spark, DATA), D.place_vectors(spark, DATA), 16)
    found = {(r.query_id, r.retriever) for r in lists.collect()}
    assert {q for q, r in found if r == "semantic"} == set(range(1, 19)) and any(r == "keyword" for _, r in found)
    rows = compare.comparative_analysis(spark, DATA).collect()
    assert {(r.config, r.query_id) for r in rows} == {(c, q) for c in compare.CONFIGS for q in range(1, 19)}
    assert all(r.grounded == 1.0 for r in rows if r.config == "hybrid")


def test_the_text_has_forecast_context_and_days(spark):
    rows = trip.plan_trip_narrative(spark, DATA).collect()
    assert rows and all(" traveler to " in r.text and "Forecast: " in r.text and "crowding in 2001-" in r.text and " visitors are expected." in r.text and "The quietest months to come: " in r.text and "Retrieved context:\n- " in r.text and "\nDay 1: " in r.text for r in rows)


def test_the_destination_follows_the_forecast_of_the_month(spark):
    d = spark.createDataFrame([(1, 2, ["culture"], 0), (2, 2, ["culture"], 1)], "destination_id int, budget_level int, tags array<string>, ord int")
    f = spark.createDataFrame([(1, "2001-09-01", "low"), (1, "2001-10-01", "high"), (2, "2001-09-01", "high"), (2, "2001-10-01", "low")], "key int, month string, crowding_level string").withColumn("month", trip.F.col("month").cast("date"))
    r = spark.createDataFrame([(1, {"culture": 0.5}, None, "2001-09"), (2, {"culture": 0.5}, None, "2001-10"), (3, {"culture": 0.5}, None, "2030-01"), (4, {"culture": 0.5}, None, None), (5, {}, 7, None)], "trip_id long, preferences map<string,double>, destination_id int, travel_month string")
    assert {x.trip_id: x.destination_id for x in trip.choose_destination(r, d, f).collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 7}
    calm = f.withColumn("crowding_z", trip.F.when(trip.F.col("crowding_level") == "low", -1.0).otherwise(1.0)).withColumn("crowding_level", trip.F.when(trip.F.col("key") == 1, "high").otherwise(trip.F.col("crowding_level")))
    assert {x.trip_id: x.destination_id for x in trip.choose_destination(r, d, calm).collect()}[4] == 2  # no month: the quietest one counts


LIKES = dict(zip(trip.S.PREFERENCES, trip.PROFILES["Luxury Traveler"], strict=True))
ASKED = "trip_id long, preferences map<string,double>, destination_id int, travel_month string, days int, max_price_level int, day_budget double, mode string"


def test_requests_that_agree_share_one_plan(spark):
    d = "/root/testdata/sf0.01"
    asked = [(t, LIKES, 3, "2001-11", 2, p, None, None) for t, p in ((5, 3), (2, None), (9, 0), (7, 3))]
    days, full, ids = trip.plan_trips(spark.createDataFrame(asked, ASKED), **trip.demo_tables(spark, d)[0])
    plans = {}
    for r in days.drop("on_roads").collect():
        plans.setdefault(r.trip_id, set()).add(tuple(r)[1:])
    assert plans.keys() == {2, 5, 7, 9} and plans[2] == plans[5] == plans[7] != plans[9]
    assert {r.trip_id for r in ids.collect()} == plans.keys() == {r.trip_id for r in full.collect()}


def test_a_request_sets_price_budget_and_mode(spark):
    d = "/root/testdata/sf0.01"
    asked = [(1, LIKES, 3, None, 2, 0, None, None), (2, LIKES, 3, None, 2, None, 200.0, None), (3, LIKES, 3, None, 2, None, None, "walking"), (4, LIKES, 3, None, 2, None, None, None), (5, LIKES, 3, None, 2, -1, None, None)]
    tables = trip.demo_tables(spark, d)[0]
    rows = trip.plan_trips(spark.createDataFrame(asked, ASKED), **tables)[0].join(tables["places"].select("id", "price_level", "category"), "id").collect()
    of = lambda t: [r for r in rows if r.trip_id == t]
    assert of(1) and all(r.price_level == 0 or r.category == "food" for r in of(1))
    assert any(r.price_level == 3 for r in of(4)) and {r.id for r in of(5)} == {r.id for r in of(4)}  # a limit that leaves nothing doesn't count
    assert max(r.day_minutes for r in of(2)) <= 200 < max(r.day_minutes for r in of(4))
    assert {(r.id, r.arrival) for r in of(3)} != {(r.id, r.arrival) for r in of(4)}


def test_meals_near_by_are_the_meals_of_the_whole_city(spark):
    """On all kinds of trips at sf0.01, and in a city of 600 places; the venues of a trip are bounded by its days."""
    for d, few in (("/root/testdata/sf0.01", None), ("/root/testdata/sf0.1", 3)):
        asked = trip.demo_requests(spark, d)
        asked = asked if few is None else asked.withColumn("destination_id", trip.F.lit(3)).limit(40)
        tables = trip.demo_tables(spark, d)[0]
        near, far = (sorted(map(tuple, trip.plan_trips(asked, **tables, near_venues=n)[0].collect())) for n in (True, False))
        assert near == far and near


def test_the_nearest_venues_are_those_of_brute_force(spark):
    import math
    import random

    from peregrin.operators.nearest import k_nearest

    rng = random.Random(3)
    spot = lambda c: (c, 60.0 * c + rng.gauss(0, 0.05 if rng.random() < 0.8 else 2.0), 10.0 + rng.gauss(0, 0.1))
    points = [(i, *spot(i % 2)) for i in range(40)] + [(100, 2, 1.0, 1.0), (101, 3, -40.0, 100.0), (102, 0, 0.0, 10.0), (103, 0, 0.0, 10.0)]
    targets = [(1000 + i, *spot(i % 2)) for i in range(300)] + [(5000, 3, 40.0, -70.0), (5001, 3, -40.0, 100.0)] + [(6000 + i, 0, 0.0, 10.0) for i in range(12)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, destination_id int, lat double, lon double")
    got = {}
    for r in k_nearest(frame(points), frame(targets), 7).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))

    def km(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return round(2 * 6371 * math.asin(min(1, math.sqrt(h))), 9)

    for p in points:
        near = sorted((km(p, t), t[0]) for t in targets if t[1] == p[1])[:7]
        assert [d for _, d in sorted(got.get(p[0], []))] == [t for _, t in near]


def test_plans_go_by_roads_where_all_legs_are_known(spark):
    d = "/root/testdata/sf0.01"
    tables = trip.demo_tables(spark, d)[0]
    F = trip.F
    ends = tables["places"].where("destination_id in (3, 4)").select("destination_id", "id").unionByName(spark.createDataFrame([(3, -1), (4, -1)], "destination_id int, id long"))
    legs = ends.withColumnRenamed("id", "src").join(ends.withColumnRenamed("id", "dst"), "destination_id").where("src <> dst")
    # City 4 lacks the legs that lead to the centre, so its trips stay on great circles.
    legs = legs.where("destination_id = 3 or dst <> -1").withColumn("profile", F.explode(F.array(F.lit("car"), F.lit("foot"))))
    legs = legs.select("destination_id", "src", "dst", "profile", (F.lit(0.5) + F.pmod(F.col("src") * 7 + F.col("dst") * 3, F.lit(9)) / 10).alias("km"), (F.lit(3.0) + F.pmod(F.col("src") + F.col("dst") * 5, F.lit(7))).alias("minutes"))
    asked = spark.createDataFrame([(1, LIKES, 3, None, 2, None, None, None), (2, LIKES, 4, None, 2, None, None, None)], ASKED)
    rows = trip.plan_trips(asked, **tables, matrix=legs)[0].collect()
    assert {(r.trip_id, r.on_roads) for r in rows} == {(1, True), (2, False)}
