"""Scalar functions on cases worked out by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from peregrin.functions import geo, scoring as S, text as T
from peregrin.operators import evaluate as E, forecast as FC, graph as G, prep as P, retrieval as R, smoothing
from peregrin.sources import landed, synthetic, tables


def one(spark, expr, **values):
    df = spark.range(1)
    for k, (v, kind) in values.items():
        df = df.withColumn(k, F.lit(v).cast(kind) if not isinstance(v, (dict, list)) else F.from_json(F.lit(__import__("json").dumps(v)), kind))
    return df.select(expr.alias("x")).first().x


def test_trim_description(spark):
    first, rest = "A" * 300 + ".", "B" * 250 + "."
    trim = lambda s: one(spark, T.trim_description(F.col("t")), t=(s, "string"))
    assert trim("Short. Text.") == "Short. Text."
    assert trim(f"{first} {rest} C.") == first
    assert trim("D" * 600 + ". E.") == "D" * 600 + "."


def test_opening_hours_and_qids(spark):
    hours = lambda s: one(spark, T.opening_hours(F.col("t")), t=(s, "string"))
    assert tuple(hours("Mo 09:30-18:00")) == (9, 18) and hours("24/7") is None and hours(None) is None and hours("25:00-26:00") is None
    qid = lambda s: one(spark, T.normalize_qid(F.col("t")), t=(s, "string"))
    assert qid("x; Q7,Q8") == "Q7" and qid("none") is None and qid(None) is None


def test_router_matches_inside_words(spark):
    route = lambda q, a=None: tuple(one(spark, T.route_query(F.col("q"), F.col("a")), q=(q, "string"), a=(a, "string")))
    assert route("a party in barcelona") == ("Culture Enthusiast", None, False)
    assert route("museum near me", "Family Traveler") == ("Family Traveler", "museum", True)
    assert route(None) == (None, None, False)


def test_tag_affinity(spark):
    f = lambda tags: one(spark, S.tag_affinity(F.col("p"), F.col("t")), p=({"culture": 0.8, "relax": 0.4}, "map<string,double>"), t=(tags, "array<string>"))
    assert f(["art", "beach"]) == pytest.approx(0.6) and f(["nature"]) == 0.3 and f(["zzz"]) == 0.3 and f([]) == 0.3


@pytest.mark.parametrize("z,level", [(-0.4, "low"), (-0.39, "medium"), (0.4, "medium"), (0.41, "high"), (None, None)])
def test_crowding_level(spark, z, level):
    assert one(spark, S.crowding_level(F.col("z")), z=(z, "double")) == level


def test_clock(spark):
    c = lambda h: one(spark, T.clock(F.col("h")), h=(h, "double"))
    assert c(13.5) == "13:30" and c(24.25) == "00:15" and c(9.999999) == "10:00"


def test_fit_view(spark):
    v = one(spark, geo.fit_view(F.col("a"), F.col("a"), F.col("b"), F.col("b")), a=(41.9, "double"), b=(12.5, "double"))
    assert v.zoom == 16.0 and (v.lat, v.lon) == (41.9, 12.5)
    v = one(spark, geo.fit_view(F.lit(41.900), F.lit(41.960), F.lit(12.5), F.lit(12.5)))
    assert v.lat == pytest.approx(41.93) and v.zoom < 16


def test_unknown_configuration(spark):
    with pytest.raises(ValueError):
        R.reciprocal_rank_fusion(spark.createDataFrame([(1, "keyword", 1, 1)], "query_id int, retriever string, doc_id int, rank int"), 5, "magic")


def test_near_edges_are_those_of_all_pairs(spark):
    rows = [(i, i % 2, 41.0 + (i * 7919 % 500) / 9000, 2.0 + (i * 104729 % 500) / 9000) for i in range(120)] + [(500, 0, 89.0, 10.0), (501, 0, 89.0, 10.5), (502, 1, -0.005, 179.99)]
    df = spark.createDataFrame(rows, "id int, destination_id int, lat double, lon double")
    got = {(r.src, r.dst) for r in G.near_edges(df).collect()}
    a, b = df.alias("a"), df.alias("b")
    km = geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    want = {tuple(r) for r in a.join(b, F.col("a.destination_id") == F.col("b.destination_id")).where((F.col("a.id") != F.col("b.id")) & (km <= 2.0)).select("a.id", "b.id").collect()}
    assert got == want and want


def test_fitted_beats_fixed_on_a_clean_season():
    y = [100 + t + 20 * ((t % 12) - 5.5) for t in range(60)]
    out = smoothing.fit(np.array([y[:48]], float), 12)[0][0]
    assert max(abs(out - y[48:])) < 0.5


def plain_smoothing(y, parameters, level, trend, season, horizon=0):
    """Squared one-step errors and forecasts of the recursion, written out."""
    alpha, beta, gamma, phi = parameters
    season, total = list(season), 0.0
    for t, x in enumerate(y):
        s = season[t % 12]
        total += (x - (level + phi * trend + s)) ** 2
        new = alpha * (x - s) + (1 - alpha) * (level + phi * trend)
        trend = beta * (new - level) + (1 - beta) * phi * trend
        season[t % 12] = gamma * (x - new) + (1 - gamma) * s
        level = new
    return total, [level + sum(phi**i for i in range(1, h + 1)) * trend + season[(len(y) + h - 1) % 12] for h in range(1, horizon + 1)]


@pytest.fixture(scope="module")
def histories(spark):
    from peregrin.plans import demand_routing as DR

    rows: dict = {}
    for r in DR._filled(spark, "/root/testdata/sf0.1").orderBy("key", "month").collect():
        rows.setdefault(r.key, []).append(r.value)
    return np.array(list(rows.values()))


def test_states_are_linear_in_what_the_recursion_starts_from(histories):
    rng = np.random.default_rng(1)
    y, p = histories[:4], rng.uniform(0.1, 0.9, (4, 4))
    errors, level, trend, season = smoothing.responses(y, p)
    states, left = smoothing.project(errors)
    for i in range(4):
        seasons = [*states[i, 3:], 0.0]
        total, ahead = plain_smoothing(y[i], p[i], states[i, 1], states[i, 2], seasons, 12)
        got = level[i] @ states[i] + np.cumsum(p[i, 3] ** np.arange(1, 13)) * (trend[i] @ states[i]) + season[i] @ states[i]
        assert total == pytest.approx((left[i] ** 2).sum()) and got.tolist() == pytest.approx(ahead)
        nudge = states[i] + np.array([0, *rng.normal(0, 0.5, 13)])
        assert plain_smoothing(y[i], p[i], nudge[1], nudge[2], [*nudge[3:], 0.0])[0] >= total - 1e-6


def test_no_grid_point_fits_better(histories):
    """Every series of sf0.1, against 625 parameter sets with the first year's mean and deviations as states, and with fitted ones."""
    forecasts, parameters, squares = smoothing.fit(histories, 12)
    axes = [np.linspace(0.05, 0.95, 5)] * 3 + [np.linspace(0.81, 0.99, 5)]
    grid = np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], axis=1)
    for y, square in zip(histories, squares, strict=True):
        errors, *_ = smoothing.responses(np.repeat(y[None], len(grid), 0), grid)
        first = np.array([1.0, 0, 0, *(y[:11] - y[:12].mean())])
        first[1] = y[:12].mean()
        assert square <= ((errors @ first) ** 2).sum(1).min() and square <= (smoothing.project(errors)[1] ** 2).sum(1).min() * (1 + 1e-6)
    assert np.isfinite(forecasts).all() and (parameters >= smoothing.LOW).all() and (parameters <= smoothing.HIGH).all()


def test_a_batch_fits_each_series_as_alone(histories):
    odd = np.vstack([histories[:3, :30], np.zeros(30), np.full(30, 7.0), np.arange(30) * 1e9])
    whole = smoothing.fit(odd, 6)[0]
    assert all(whole[i] == pytest.approx(smoothing.fit(odd[i : i + 1], 6)[0][0], rel=1e-3, abs=1e-3) for i in range(len(odd)))
    assert whole[4].tolist() == pytest.approx([7.0] * 6) and whole[3].tolist() == pytest.approx([0.0] * 6)


def test_series_that_cannot_be_fitted_have_no_forecast(spark):
    rows = [("short", m, 1.0) for m in range(23)] + [("gap", m, None if m == 5 else 1.0) for m in range(30)] + [("fine", m, float(m % 12)) for m in range(25)]
    s = spark.createDataFrame(rows, "key string, m int, value double").select("key", F.add_months(F.lit("2020-01-01").cast("date"), "m").alias("month"), "value")
    for model in ("holt_winters", "trend_season"):
        got = FC.forecast_fitted(s, 3, model).orderBy("month").collect()
        assert [(r.key, str(r.month)) for r in got] == [("fine", "2022-02-01"), ("fine", "2022-03-01"), ("fine", "2022-04-01")]
    with pytest.raises(ValueError):
        FC.forecast_fitted(s, 3, "magic")


def test_constant_series_has_no_z(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0)], "key string, month int, value double")
    assert {r.crowding_level for r in FC.crowding(df, FC.history_stats(df)).collect()} == {None}


def test_recall_is_null_without_gold(spark):
    hits = spark.createDataFrame([("f", 1, 5), ("f", 2, 6)], "config string, query_id int, doc_id int")
    gold = spark.createDataFrame([(1, 5), (1, 7)], "query_id int, doc_id int")
    assert {(r.query_id, r.recall) for r in E.recall(hits, gold, ["config", "query_id"]).collect()} == {(1, 0.5), (2, None)}


def test_gate_takes_a_key_as_a_whole(spark):
    rows = spark.createDataFrame([("Q1", 1, 0.0, 0.0), ("Q1", 2, 9.0, 9.0), ("Q2", 3, 0.0, 0.0), (None, 4, 0.0, 0.0), ("Q3", 5, 0.0, 0.0)], "key string, id int, lat double, lon double")
    known = spark.createDataFrame([("Q1", 0.0, 0.0), ("Q2", 0.01, 0.0), ("Q3", None, None)], "key string, known_lat double, known_lon double")
    assert {r.id for r in P.place_gate(rows, known).collect()} == {3, 4}


def test_refresh_places(spark):
    element = "ord int, destination_id string, city string, type string, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
    rows = [
        (1, "VIE", "Vienna", "node", 48.2, 16.37, None, {"name": "Dom", "historic": "yes"}),
        (2, "VIE", "Vienna", "node", 48.2, 16.37, None, {"name": "dom ", "historic": "yes", "wikidata": "Q1", "opening_hours": "08:00-20:00", "fee": "no"}),
        (3, "VIE", "Vienna", "way", None, None, (48.21, 16.37), {"name": "Art", "tourism": "museum", "wikidata": "Q2"}),
        (4, "VIE", "Vienna", "node", 10.0, 10.0, None, {"name": "Far", "tourism": "museum", "wikidata": "Q3"}),
        (5, "VIE", "Vienna", "node", 48.2, 16.37, None, {"name": "Bank", "amenity": "bank"}),
    ]
    info = spark.createDataFrame([("Q1", "old church in Vienna", None, 900, 50), ("Q2", None, "Art  shows.", 10, 1), ("Q3", None, None, 1, 1)], "qid string, description string, summary string, views int, links int")
    known = spark.createDataFrame([("Q1", 48.2, 16.37), ("Q2", 48.21, 16.37), ("Q3", 48.2, 16.37)], "key string, known_lat double, known_lon double")
    got = {r.name.strip().lower(): r for r in P.refresh_places(spark.createDataFrame(rows, element), info, known).collect()}
    assert set(got) == {"dom", "art"}
    assert (got["dom"].open_hour, got["dom"].price_level, got["dom"].category) == (8, 0, "landmark") and got["dom"].description == "dom  is an old church in Vienna."
    assert got["art"].lat == 48.21 and got["art"].description_source == "wikipedia" and got["dom"].popularity_score == 5.0


def test_csv_guides_and_corpus(spark, tmp_path):
    (tmp_path / "d.csv").write_text('destination_id,city,country,lat,lon,budget_level,tags\nVIE,Vienna,Austria,48.2,16.37,3,"[""culture"", ""music""]"\n')
    (tmp_path / "guides").mkdir()
    (tmp_path / "guides" / "VIE.txt").write_text("About Vienna.\nSecond line.")
    cities = tables.read_csv(spark, str(tmp_path / "d.csv"), "destinations")
    assert cities.first().tags == ["culture", "music"]
    guides = tables.read_guides(spark, str(tmp_path / "guides"))
    places = spark.createDataFrame([("POI0001", "VIE", "Dom", "landmark", None)], "poi_id string, destination_id string, name string, category string, description string")
    got = {r.doc_id: r.text for r in tables.corpus(guides, places, cities).collect()}
    assert got == {"guide::VIE": "About Vienna.\nSecond line.", "poi::POI0001": "Dom (landmark) in Vienna: "}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", "NEAR"), ("a", "c", "PREFERS")], "src string, dst string, relation string")
    tables.write_edges(df, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).where("relation = 'NEAR'").count() == 1
    tables.write_table(df.select("src"), str(tmp_path / "t"), "text")
    tables.write_table(df, str(tmp_path / "c"), "csv")
    assert spark.read.text(str(tmp_path / "t")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_saved_responses(spark):
    body = '{"query": {"normalized": [{"from": "a_b", "to": "A b"}], "pages": {"1": {"title": "A b", "coordinates": [{"lat": 1.5, "lon": 2.5}]}, "2": {"title": "C"}}}}'
    got = landed.article_coordinates(spark.createDataFrame([(body,)], "body string")).collect()
    assert [tuple(r) for r in got] == [("a_b", 1.5, 2.5)]
    views = landed.monthly_views(spark.createDataFrame([("A", '{"items": [{"views": 10}, {"views": 15}]}')], "title string, body string")).first()
    assert views["views"] == 12
    assert landed.summaries(spark.createDataFrame([("A", '{"extract": " x \\n y "}'), ("B", "{}")], "title string, body string")).collect()[0].summary == "x y"
    e = landed.map_elements(spark.createDataFrame([("VIE", '{"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "N"}}]}'), ("X", '{"remark": "timeout", "elements": []}')], "destination_id string, body string")).collect()
    assert {(r.destination_id, r.id, r.remark) for r in e} == {("VIE", 1, None), ("X", None, "timeout")}


def test_generated_tables(spark):
    profiles = {"a": {"x": 0.9, "y": 0.1}, "b": {"x": 0.1, "y": 0.9}}
    s = synthetic.survey(spark, profiles, 20)
    assert s.count() == 40 and s.where("x < 0 or x > 1").count() == 0
    cities = spark.createDataFrame([("VIE", "Vienna", 48.2, 16.37)], "destination_id string, city string, lat double, lon double")
    assert synthetic.scattered_places(cities, 30).count() == 30 and synthetic.demand(spark, cities).where("visitors >= 0").count() == 89


def test_stream_equals_batch(spark, tmp_path):
    from peregrin.streaming import demand as SD

    events = spark.createDataFrame([(i, f"2024-01-{1 + i // 4:02d} 0{i % 4}:00:00", i % 3, "view", 1.0, "{}") for i in range(40)], "event_id long, t string, user_id long, event_type string, value double, props string")
    events.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "in"))
    q = SD.write_demand(SD.windowed_demand(SD.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < out.count() <= 10 and out.where("n <> 4").count() == 0


def test_rounding_is_that_of_the_binary_value(spark):
    import random

    from peregrin.functions.scoring import popularity_of_share, round_half_even

    rng = random.Random(1)
    values = [k / 1000 for k in range(0, 6000, 5)] + [k / 8 for k in range(200)] + [rng.uniform(0, 50) for _ in range(500)] + [-1.5, -2.675]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").select("x", *(round_half_even(F.col("x"), d).alias(f"r{d}") for d in (1, 2, 3)))
    for r in df.collect():
        assert [r.r1, r.r2, r.r3] == [None if r.x is None else round(r.x, d) for d in (1, 2, 3)]
    assert spark.range(1).select(popularity_of_share(F.lit(0.05)).alias("p")).first().p == 2.62


def test_the_fallback_counts_only_what_it_keeps(spark):
    from peregrin.operators import graph as G

    places = spark.createDataFrame([(i, 1, "beach", 40.0, 2.0, float(i)) for i in range(50)], "id long, destination_id int, category string, lat double, lon double, popularity double")
    hubs = places.limit(0)
    q = spark.createDataFrame([(1, 1, None, None, False)], "query_id long, destination_id int, archetype string, category string, near_transport boolean")
    got = G.graph_search(q, places, hubs, G.affinity_table(spark), 10).orderBy("rank").collect()
    assert [r.score for r in got] == [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1] and {r.reason for r in got} == {"top-rated in city"} and got[0].doc_id == 49
    liked = spark.createDataFrame([(2, 1, "Beach & Relax", None, False)], q.schema)
    assert G.graph_search(liked, places, hubs, G.affinity_table(spark), 48).count() == 48


def test_standard_retrieves_nothing(spark):
    from peregrin.operators import retrieval as R

    lists = spark.createDataFrame([(1, "keyword", 5, 1)], "query_id long, retriever string, doc_id long, rank int")
    assert R.reciprocal_rank_fusion(lists, 5, "standard").count() == 0
    with pytest.raises(ValueError):
        R.reciprocal_rank_fusion(lists, 5, "other")


def test_entity_answers(spark):
    import json

    def item(q, n, **more):
        return {"item": {"value": f"http://x/entity/{q}"}, "sitelinks": {"value": str(n)}} | {k: {"value": v} for k, v in more.items()}

    bodies = [json.dumps({"results": {"bindings": [item("Q1", 5, itemDescription="a tower", articleName="Tower"), item("Q2", 0)]}}), json.dumps({"results": {"bindings": []}}), "nothing", None]
    got = {r.qid: (r.description, r.sitelinks, r.title) for r in landed.entity_answers(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()}
    assert got == {"Q1": ("a tower", 5, "Tower"), "Q2": (None, 0, None)}
    keys = spark.createDataFrame([(f"Q{i}",) for i in range(1000)] + [("Q5",), (None,), ("x",), ("Q7; Q8",)], "qid string")
    chunks = [r.qids for r in landed.entity_chunks(keys).collect()]
    assert sorted(q for c in chunks for q in c) == sorted(f"Q{i}" for i in range(1000)) and max(map(len, chunks)) <= 400


def test_request_states(spark):
    log = [("a", 1, 500, None), ("a", 2, 200, '{"x": 1}'), ("b", 1, 404, None), ("c", 1, 429, None), ("c", 2, None, None), ("d", 1, 503, None), ("d", 2, 503, None), ("d", 3, 503, None), ("d", 4, 503, None), ("e", 1, 200, "{broken")]
    got = {r.key: (r.state, r.wait) for r in landed.request_states(spark.createDataFrame(log, "key string, at int, status int, body string")).collect()}
    assert got == {"a": ("answered", None), "b": ("absent", None), "c": ("retry", 10.0), "d": ("given up", None), "e": ("retry", 5.0)}


def test_edges_are_read_back(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, "NEAR"), (3, 4, "HAS_POI")], "src int, dst int, relation string")
    tables.write_edges(edges, str(tmp_path / "e"))
    assert tables.read_edges(spark, str(tmp_path / "e")).count() == 2 and [r.src for r in tables.read_edges(spark, str(tmp_path / "e"), "NEAR").collect()] == [1]


def test_templates_and_context(spark):
    import textwrap

    for text in ("\n    a\n      b\n\n    c\n  ", "a", "", "  x\n y\n   \n"):
        assert one(spark, T.dedent(F.lit(text))) == textwrap.dedent(text).strip()
    line = lambda why: one(spark, T.context_line(F.lit("Tower"), F.lit("landmark"), F.lit("high"), F.lit(why).cast("string")))
    assert line("near a hub") == "Tower (landmark): high [graph: near a hub]" and line(None) == "Tower (landmark): high"


def test_grounding_probe(spark):
    answers = spark.createDataFrame([("R", "- Old Tower\n* the Great Museum of Art\n\nNowhere"), ("S", ""), ("T", "tower")], "destination_id string, text string")
    names = spark.createDataFrame([("Old Tower",), ("Great Museum",)], "name string")
    assert {r.destination_id: (r.named, r.matched) for r in E.grounding_probe(answers, names).collect()} == {"R": (3, 2), "T": (1, 1)}


def test_changes_of_slope_are_followed():
    """A rise that stops half way, with a season: the forecast stays level, as a single line would not."""
    import numpy as np

    months = np.arange(84)
    y = 1000 + 20 * np.minimum(months, 42) + 50 * np.sin(2 * np.pi * months / 12)
    assert FC.fit_changepoints(y[:72].tolist(), 12) == pytest.approx(y[72:], rel=0.02)
    line = 1000 + 20 * months + 50 * np.cos(2 * np.pi * months / 12)
    assert FC.fit_changepoints(line[:72].tolist(), 12) == pytest.approx(line[72:], rel=0.01)
    assert FC.fit_changepoints([0.0] * 24, 3) == pytest.approx([0, 0, 0])


def test_numbers_follow_one_order(spark):
    rows = [(k, o) for o in range(40) for k in (3, 1, None)]
    got = P.numbered(spark.createDataFrame(rows, "destination_id int, ord int").repartition(7), ["destination_id", "ord"]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.destination_id, r.ord) for r in sorted(got, key=lambda r: r.poi_id)] == want
    assert sorted(r.poi_id for r in got) == [f"POI{i:04d}" for i in range(1, 121)]


def test_nearest_hub_is_that_of_all_pairs(spark):
    places = spark.range(300).selectExpr("id", "id % 3 as destination_id", "'museum' as category", "80 + id * 7919 % 900 / 10000.0D as lat", "2 + id * 104729 % 9000 / 10000.0D as lon")
    hubs = places.where("id % 20 = 0")
    h = hubs.select("destination_id", F.col("lat").alias("a"), F.col("lon").alias("b"))
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"))
    want = places.join(h, "destination_id").groupBy("id").agg(F.min(km).alias("km")).where("km <= 1.5").select("id", S.round_half_even(F.col("km"), 2).alias("km"))
    got = {r.id: r.nearest_hub_km for r in G.nearest_hub(places, hubs, 1.5).collect()}
    assert got == {r.id: r.km for r in want.collect()} and 15 < len(got) < 300
