"""Queries of demand, segments, destinations and routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo, scoring as S, text as T
from ..operators import cluster as C, forecast as FC, retrieval as R, routing as RT
from ..sources import landed as L
from . import demo as D

PREFERENCES = {"budget": 0.1, "culture": 0.2, "nature": 0.9, "nightlife": 0.1, "relax": 0.3, "adventure": 0.9}
TAGS = [["culture", "history", "food"], ["beach", "romance", "unknown"], ["nightlife", "luxury"], [], ["nature", "music", "art"]]
TEST_MONTHS = 6


def demand_monthly(spark, d):
    return D.demand(spark, d).select("key", "month", F.col("value").cast("long").alias("value"))


def demand_since(spark, d):
    return D.demand(spark, d).where(F.col("month") >= F.lit("1998-07-01").cast("date")).select("key", F.date_format("month", "yyyy-MM").alias("month"), "value")


def demand_spine(spark, d):
    return FC.month_spine(D.demand(spark, d)).select("key", "month", "value")


def crowding_zscore(spark, d):
    series = D.demand(spark, d)
    return FC.crowding(series, FC.history_stats(series)).select("key", "month", "crowding_z", "crowding_level")


def _filled(spark, d):
    """The spine with gaps as 0: no orders that month."""
    return FC.month_spine(D.demand(spark, d)).select("key", "month", F.coalesce("value", F.lit(0)).cast("double").alias("value"))


def holt_winters_fixed(spark, d):
    return FC.forecast_fixed(_filled(spark, d), 12).select("key", "month", F.round("forecast", 4).alias("forecast"))


def holt_winters_fitted(spark, d):
    return FC.forecast_fitted(_filled(spark, d), 12).select("key", "month", F.round("forecast", 4).alias("forecast"))


def trend_season_fitted(spark, d):
    return FC.forecast_fitted(_filled(spark, d), 12, "trend_season").select("key", "month", F.round("forecast", 4).alias("forecast"))


def best_months(spark, d):
    """By the mean of each calendar month over the history."""
    series = _filled(spark, d)
    season = series.groupBy("key", F.month("month").alias("m")).agg(F.avg("value").alias("forecast"))
    rows = season.withColumn("month", F.make_date(F.lit(2002), "m", F.lit(1)))
    return FC.best_months(rows, FC.history_stats(series), 3).select("key", F.date_format("month", "yyyy-MM").alias("month"), "crowding_z", "crowding_level", "rank")


def best_forecast_months(spark, d):
    """The months of least crowding among the twelve to come."""
    series = _filled(spark, d)
    rows = FC.forecast_fixed(series, 12).select("key", "month", F.round("forecast", 4).alias("forecast"))
    return FC.best_months(rows, FC.history_stats(series), 3).select("key", F.date_format("month", "yyyy-MM").alias("month"), "crowding_z", "crowding_level", "rank")


def travel_month(spark, d):
    """The row of the wanted month, for each nation another; beyond the horizon the first."""
    rows = FC.month_spine(D.demand(spark, d)).where(F.col("month") >= F.lit("2001-01-01").cast("date")).select("key", "month", "value")
    wanted = F.concat(F.lit("2001-"), F.lpad((F.col("key") % 12 + 1).cast("string"), 2, "0"))
    return FC.pick_month(rows, wanted).select("key", "month", "month_matched")


def seasonal_naive_backtest(spark, d):
    e = FC.errors(FC.seasonal_naive(_filled(spark, d), TEST_MONTHS))
    return e.select("key", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


def model_backtest(spark, d):
    series = _filled(spark, d)
    return FC.backtest(series, TEST_MONTHS, "holt_winters").unionByName(FC.backtest(series, TEST_MONTHS, "trend_season"))


def model_backtest_summary(spark, d):
    return model_backtest(spark, d).groupBy("model").agg(F.round(F.avg("mae"), 1).alias("mae"), F.round(F.avg("rmse"), 1).alias("rmse"))


def segment_kmeans(spark, d):
    found, named = C.segment(D.table(spark, d, "embeddings").select("vec_id", "embedding", "label"), "embedding", "label", 10)
    return found.select("vec_id", "cluster").join(F.broadcast(named.select("cluster", "segment")), "cluster")


def centroid_classify(spark, d):
    e = D.table(spark, d, "embeddings")
    return C.classify(e, C.label_centroids(e, "embedding", "label"), "vec_id", "embedding", 3)


def majority_label(spark, d):
    """The commonest segment of each nation's customers."""
    votes = D.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("key"), F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"))
    return R.top(votes, ["key"], [F.desc("n"), F.asc("name")], 1).select("key", "name", "n")


def _scored(spark, d):
    prefs = F.create_map(*(F.lit(x) for kv in PREFERENCES.items() for x in kv))
    tags = F.element_at(F.array(*(F.array(*(F.lit(t) for t in ts)).cast("array<string>") for ts in TAGS)), (F.col("n_nationkey") % 5 + 1).cast("int"))
    rows = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), tags.alias("tags"), (F.col("n_nationkey") % 3 + 1).alias("level"))
    series = D.demand(spark, d)
    month = FC.crowding(series, FC.history_stats(series)).where(F.col("month") == F.lit("2001-06-01").cast("date")).select("key", "crowding_level")
    rows = rows.join(month, "key", "left")
    affinity, fit = S.tag_affinity(prefs, F.col("tags")), S.budget_fit(F.col("level"), prefs["budget"])
    penalty = F.coalesce(S.crowd_penalty(F.col("crowding_level")), F.lit(0.0))
    return rows.select("key", F.round(affinity, 6).alias("affinity"), F.round(fit, 6).alias("fit"), penalty.alias("penalty"), F.round(S.destination_score(affinity, fit, penalty), 6).alias("score"))


def destination_score(spark, d):
    return _scored(spark, d)


def best_destination(spark, d):
    return _scored(spark, d).orderBy(F.desc("score"), F.asc("key")).limit(1).select("key", "score")


def _hub_stops(spark, d):
    return D.hubs(spark, d).select(F.col("destination_id").cast("long").alias("trip_id"), "id", "lat", "lon")


def travel_mode_legs(spark, d):
    mode = F.element_at(F.array(F.lit("walking"), F.lit("driving"), F.lit("hybrid"), F.lit("unknown")), (F.col("trip_id") % 4 + 1).cast("int"))
    return RT.legs(_hub_stops(spark, d), mode, digits=6).select("trip_id", "src", "dst", "km", "minutes")


def supplied_matrix_fallback(spark, d):
    """Trips with an even id have a whole matrix on roads, of the others one leg is missing."""
    stops = _hub_stops(spark, d)
    a, b = stops.select("trip_id", F.col("id").alias("src")), stops.select("trip_id", F.col("id").alias("dst"))
    matrix = a.join(b, "trip_id").where("src <> dst").where("trip_id % 2 = 0 or src < dst").select("trip_id", "src", "dst", F.lit("foot").alias("profile"), F.lit(7.0).alias("km"), F.lit(42.0).alias("minutes"))
    return RT.legs(stops, F.lit("walking"), matrix).select("trip_id", "src", "dst", F.round("km", 6).alias("km"), F.round("minutes", 6).alias("minutes"), "on_roads")


def _ordered_stops(spark, d):
    s = R.top(D.stops(spark, d), ["trip_id"], [F.asc("id")], 2**31 - 1)
    return s.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "lat", "lon", "visit", "open", "close"))).alias("stops"))


def day_schedule(spark, d):
    r = _ordered_stops(spark, d).select("trip_id", RT.schedule(F.col("stops"), 9.0, 480.0, "hybrid").alias("s"))
    return r.select("trip_id", F.size("s.kept").cast("long").alias("n"), F.bround("s.km", 4).alias("km"), F.floor((F.col("s.clock") - 9.0) * 60 + 1e-9).cast("long").alias("minutes"), F.concat_ws(",", F.transform("s.kept", lambda x: x["id"].cast("string"))).alias("ids"))


def nn_tour(spark, d):
    return RT.tours(D.hubs(spark, d).select(F.col("destination_id").alias("trip_id"), "id", "lat", "lon"), two_opt=False)


def two_opt_tour(spark, d):
    return RT.tours(D.hubs(spark, d).select(F.col("destination_id").alias("trip_id"), "id", "lat", "lon"))


def tour_length(spark, d):
    at = _hub_stops(spark, d)
    numbered = R.top(at, ["trip_id"], [F.asc("id")], 2**31 - 1).withColumnRenamed("rank", "seq")
    return RT.route_length(numbered).select("trip_id", F.round("km", 6).alias("km"))


def _candidates(spark, d, days):
    """A trip's candidates: its max(12, 8 * days) most popular sights, and its food places as meals."""
    s = D.stops(spark, d).join(D.places(spark, d).select("id", "popularity"), "id")
    sights = R.top(s.where("category <> 'food'"), ["trip_id"], [F.desc("popularity"), F.asc("id")], max(12, 8 * days)).withColumn("role", F.lit("sight"))
    meals = R.top(s.where("category = 'food'"), ["trip_id"], [F.desc("popularity"), F.asc("id")], max(12, 8 * days)).withColumn("role", F.lit("meal"))
    return sights.unionByName(meals)


def multi_day_itinerary(spark, d):
    return RT.itineraries(_candidates(spark, d, 3), days=3, meals_per_day=2).drop("on_roads", "settled")


def multi_day_by_car(spark, d):
    return RT.itineraries(_candidates(spark, d, 2), days=2, mode="driving", fill=False).drop("on_roads", "settled")


def _road_answers(spark, d):
    """A saved distance table per nation and profile over all its hubs, and the hubs with their places in it. Ways there and back differ."""
    k = F.col("id")
    hubs = R.top(D.hubs(spark, d).select(F.col("destination_id").cast("long").alias("trip_id"), "id", "lat", "lon", (k * 7919 % 2000).alias("y"), (k * 104729 % 2000).alias("x")), ["trip_id"], [F.asc("id")], 2**31 - 1)
    hubs = hubs.withColumn("place", F.col("rank") - 1).drop("rank")
    a, b = hubs.alias("a"), hubs.alias("b")
    line = F.abs(F.col("a.y") - F.col("b.y")) * 11 + F.abs(F.col("a.x") - F.col("b.x")) * 8
    foot = F.when(F.col("a.id") == F.col("b.id"), 0).otherwise(line + (F.col("a.id") * 31 + F.col("b.id") * 17) % 7 * 50 + 40)
    car = F.when(F.col("a.id") == F.col("b.id"), 0).otherwise(line + (F.col("a.id") * 13 + F.col("b.id") * 29) % 11 * 60 + 300)
    pairs = a.join(b, F.col("a.trip_id") == F.col("b.trip_id")).select(F.col("a.trip_id").alias("trip_id"), F.col("a.place").alias("i"), F.col("b.place").alias("j"), F.explode(F.create_map(F.lit("foot"), F.struct(foot.alias("m"), F.floor(foot * 4 / 5).alias("s")), F.lit("car"), F.struct(car.alias("m"), F.floor(car / 7).alias("s")))).alias("profile", "v"))
    rows = pairs.groupBy("trip_id", "profile", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("row"))
    whole = rows.groupBy("trip_id", "profile").agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("rows"))
    table = lambda c: F.transform("rows", lambda r: F.transform(r["row"], lambda x: x["v"][c]))
    return whole.select("trip_id", "profile", F.to_json(F.struct(F.lit("Ok").alias("code"), table("m").alias("distances"), table("s").alias("durations"))).alias("body")), hubs


def road_itinerary(spark, d):
    """A day over all hubs of each nation by the road tables saved for it: on to the nearest by road, on foot up to 1.2 km, else by car."""
    raw, hubs = _road_answers(spark, d)
    k = F.col("id")
    stops = hubs.select("trip_id", "id", "lat", "lon", (F.lit(10) + k % 4 * 5).cast("int").alias("visit"), (F.lit(8) + k % 5).cast("int").alias("open"), F.when(k % 7 == 0, 2).otherwise(F.lit(17) + k % 5).cast("int").alias("close"), F.lit("landmark").alias("category"))
    days = RT.itineraries(stops, days=1, mode="hybrid", fill=False, two_opt=False, matrix=L.road_matrix(raw, hubs.select("trip_id", "place", "id")))
    return days.select("trip_id", "seq", "id", F.round("arrival", 6).alias("arrival"), F.round("finish", 6).alias("finish"), "day_km", "day_minutes", "on_roads")


def zone_balance(spark, d):
    return C.zone_places(_candidates(spark, d, 3).where("role = 'sight'"), 3)


def meal_targets(spark, d):
    n = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), (F.col("n_nationkey") % 4 + 1).cast("int").alias("meals"))
    two = F.slice(F.array(F.lit(0.40), F.lit(0.85)), 1, F.col("meals"))
    more = F.transform(F.sequence(F.lit(1), F.col("meals")), lambda i: i / (F.col("meals") + 1))
    rows = n.select("key", F.posexplode(F.when(F.col("meals") <= 2, two).otherwise(more)).alias("i", "part"))
    return rows.select("key", "i", F.round(F.lit(9.0) + F.col("part") * 8.0, 6).alias("hour"), T.clock(F.lit(9.0) + F.col("part") * 8.0).alias("clock"))


def meal_reserve(spark, d):
    """The upper median visit of each nation's food places, for two meals, at most half of 480 minutes."""
    food = D.stops(spark, d).where("category = 'food'").groupBy("trip_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY visit DESC)").alias("typical"))
    return food.select("trip_id", F.least(F.lit(2) * F.col("typical") * F.lit(1.25), F.lit(240.0)).cast("int").alias("minutes"))


def open_now(spark, d):
    s = D.stops(spark, d)
    return s.groupBy("trip_id").agg(*(F.count_if(RT.open_at(F.lit(h), F.col("open"), F.col("close"))).alias(f"open_{int(h)}") for h in (9.0, 18.0, 23.0)))


def price_filter_fallback(spark, d):
    """Places up to the trip's price level; all of a trip's if none is."""
    s = D.places(spark, d).select(F.col("destination_id").alias("trip_id"), "id", (F.col("id") % 4).alias("price_level"), (F.col("destination_id") % 3 - 1).alias("most_price"))
    return RT.within_budget(s).select(F.col("trip_id").alias("destination_id"), "id", F.col("price_level").alias("price"))


def empty_fallback(spark, d):
    """Found places of even nations; for the rest the first five in order."""
    p = D.places(spark, d).select("destination_id", "id", "category")
    found = p.where("destination_id % 2 = 0 and category = 'museum'").select("destination_id", "id")
    trips = D.cities(spark, d).select("destination_id")
    lost = trips.join(found.select("destination_id").distinct(), "destination_id", "left_anti")
    first = R.top(p.join(lost, "destination_id"), ["destination_id"], [F.asc("id")], 5).select("destination_id", "id")
    return found.unionByName(first)


def map_fit(spark, d):
    box = D.places(spark, d).groupBy("destination_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    v = box.select("destination_id", geo.fit_view(F.col("s"), F.col("n"), F.col("w"), F.col("e")).alias("v"))
    return v.select("destination_id", F.round("v.zoom", 6).alias("zoom"), F.round("v.lat", 6).alias("lat"), F.round("v.lon", 6).alias("lon"))


def bounding_boxes(spark, d):
    b = D.hubs(spark, d).select("id", geo.bounding_box(F.col("lat"), F.col("lon"), F.lit(1500.0)).alias("b"))
    return b.select("id", *(F.round(f"b.{x}", 6).alias(x) for x in ("south", "west", "north", "east")))


def clock_format(spark, d):
    return D.table(spark, d, "customer").select("c_custkey", T.clock((F.col("c_custkey") * 37 % 2880) / F.lit(97.0)).alias("clock"))


def month_format(spark, d):
    return D.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("ym"), F.date_format("o_orderdate", "MMMM yyyy").alias("name"))


QUERIES = {f.__name__: f for f in (demand_monthly, demand_since, demand_spine, crowding_zscore, holt_winters_fixed, holt_winters_fitted, trend_season_fitted, best_months, best_forecast_months, travel_month, seasonal_naive_backtest, model_backtest, model_backtest_summary, segment_kmeans, centroid_classify, majority_label, destination_score, best_destination, travel_mode_legs, supplied_matrix_fallback, day_schedule, nn_tour, two_opt_tour, tour_length, multi_day_itinerary, multi_day_by_car, road_itinerary, zone_balance, meal_targets, meal_reserve, open_now, price_filter_fallback, empty_fallback, map_fit, bounding_boxes, clock_format, month_format)}

# ------------------------------------------------------------------------ SQL

SPINE = """ends AS (SELECT key, min(month) AS a, max(month) AS b FROM demand GROUP BY key),
spine AS (SELECT key, m::DATE AS month FROM (SELECT key, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS m FROM ends)),
filled AS (SELECT s.key, s.month, d.value, coalesce(d.value, 0)::DOUBLE AS y FROM spine s LEFT JOIN demand d ON s.key = d.key AND s.month = d.month)"""
LEVEL = "CASE WHEN {z} <= -0.4 THEN 'low' WHEN {z} <= 0.4 THEN 'medium' WHEN {z} > 0.4 THEN 'high' END"
Z = f"""stats AS (SELECT key, avg(value) AS mean, stddev_samp(value) AS std FROM demand GROUP BY key),
z AS (SELECT key, month, round((value - mean) / nullif(std, 0), 6) AS crowding_z FROM demand JOIN stats USING (key)),
crowd AS (SELECT *, {LEVEL.format(z='crowding_z')} AS crowding_level FROM z)"""
STOPS = f"""{D.PLACES},
stops AS (SELECT destination_id::BIGINT AS trip_id, id, lat, lon, category, (30 + id % 4 * 15)::INT AS visit, (8 + id % 3)::INT AS open, (CASE WHEN id % 7 = 0 THEN 2 ELSE 17 + id % 5 END)::INT AS close FROM places)"""
SCORED = f"""{D.DEMAND}, {Z},
tags(i, tag) AS (VALUES {", ".join(f"({i}, '{t}')" for i, ts in enumerate(TAGS) for t in ts)}),
prefs(tag, p) AS (VALUES {", ".join(f"('{t}', {PREFERENCES[p]}::DOUBLE)" for t, p in S.TAG_PREFERENCE.items())}),
aff AS (SELECT n_nationkey AS key, avg(p) AS a FROM nation JOIN tags ON i = n_nationkey % 5 JOIN prefs USING (tag) GROUP BY 1),
parts AS (SELECT n_nationkey AS key, coalesce(a, 0.3::DOUBLE) AS a, 1.0::DOUBLE - abs(n_nationkey % 3 + 1 - (0.1::DOUBLE * 2 + 1)) / 2 AS f,
  coalesce(CASE crowding_level WHEN 'low' THEN 0.0 WHEN 'medium' THEN 0.15 WHEN 'high' THEN 0.35 END, 0.0)::DOUBLE AS p
  FROM nation LEFT JOIN aff ON aff.key = n_nationkey LEFT JOIN crowd ON crowd.key = n_nationkey AND month = DATE '2001-06-01'),
scored AS (SELECT key, round(a, 6) AS affinity, round(f, 6) AS fit, p AS penalty, round(0.5::DOUBLE * a + 0.3::DOUBLE * f - p, 6) AS score FROM parts)"""
LEG = "CASE WHEN {m} = 'driving' OR ({m} = 'hybrid' AND {km} > 1.2) THEN {km} / 25.0::DOUBLE * 60 + 8 ELSE {km} / 4.5::DOUBLE * 60 END"
PAIRS = f"pairs AS (SELECT a.destination_id::BIGINT AS trip_id, a.id AS src, b.id AS dst, {D.km('a.', 'b.')} AS km FROM hubs a JOIN hubs b ON a.destination_id = b.destination_id AND a.id <> b.id)"
HW_STEP = "0.3::DOUBLE * (y - season[1]) + 0.7::DOUBLE * (l + 0.98::DOUBLE * b)"
#: A month's forecast from the last state, as it is; HW rounds it.
HW_RAW = "l + b * 0.98::DOUBLE * (1 - pow(0.98::DOUBLE, h)) / (1 - 0.98::DOUBLE) + season[h]"
HW_FORECAST = f"round({HW_RAW}, 4)"
HW = f"""WITH RECURSIVE {D.DEMAND}, {SPINE},
num AS (SELECT key, month, y, row_number() OVER (PARTITION BY key ORDER BY month) AS t, count(*) OVER (PARTITION BY key) AS n FROM filled),
st AS (SELECT key, avg(y) AS l FROM num WHERE t <= 12 AND n >= 12 GROUP BY key),
s0 AS (SELECT key, list(y - l ORDER BY t) AS season, any_value(l) AS l FROM num JOIN st USING (key) WHERE t <= 12 GROUP BY key),
run(key, t, l, b, season) AS (SELECT key, 12::BIGINT, l, 0.0::DOUBLE, season FROM s0
  UNION ALL SELECT key, t, nl, 0.1::DOUBLE * (nl - l) + 0.9::DOUBLE * 0.98::DOUBLE * b, list_append(season[2:12], 0.2::DOUBLE * (y - nl) + 0.8::DOUBLE * season[1])
  FROM (SELECT r.key, num.t, r.l, r.b, r.season, num.y, 0.3::DOUBLE * (num.y - r.season[1]) + 0.7::DOUBLE * (r.l + 0.98::DOUBLE * r.b) AS nl FROM run r JOIN num ON num.key = r.key AND num.t = r.t + 1)),
last AS (SELECT r.*, e.b AS month FROM run r JOIN (SELECT key, max(t) AS t FROM num GROUP BY key) m ON r.key = m.key AND r.t = m.t JOIN ends e ON e.key = r.key)
SELECT key, (month + to_months(h::INT))::DATE AS month, {HW_FORECAST} AS forecast FROM last, (SELECT unnest(generate_series(1, 12)) AS h)"""
DAY = f"""WITH RECURSIVE {STOPS},
o AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY id) AS r FROM stops),
walk AS (SELECT trip_id, 0::BIGINT AS r, 9.0::DOUBLE AS clock, 0.0::DOUBLE AS km, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, []::BIGINT[] AS ids FROM o GROUP BY trip_id
  UNION ALL SELECT trip_id, r, CASE WHEN fits THEN finish ELSE clock END, CASE WHEN fits THEN km + leg ELSE km END, CASE WHEN fits THEN lat2 ELSE lat END, CASE WHEN fits THEN lon2 ELSE lon END, CASE WHEN fits THEN list_append(ids, id) ELSE ids END
  FROM (SELECT *, there < (CASE WHEN close < open THEN 24.0 ELSE close END) AND (finish - 9.0) * 60 <= 480 AS fits
    FROM (SELECT *, greatest(there, open::DOUBLE) + visit / 60.0::DOUBLE AS finish
      FROM (SELECT *, clock + (CASE WHEN lat IS NULL THEN 0.0::DOUBLE ELSE {LEG.format(m="'hybrid'", km='leg')} END) / 60.0::DOUBLE AS there
        FROM (SELECT w.trip_id, o.r, w.clock, w.km, w.lat, w.lon, w.ids, o.id, o.lat AS lat2, o.lon AS lon2, o.visit, o.open, o.close, coalesce({D.km('w.', 'o.')}, 0.0::DOUBLE) AS leg FROM walk w JOIN o ON o.trip_id = w.trip_id AND o.r = w.r + 1)))))
SELECT trip_id, len(ids)::BIGINT AS n, round(km, 4) AS km, floor((clock - 9.0) * 60 + 1e-9)::BIGINT AS minutes, array_to_string(ids, ',') AS ids FROM (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY r DESC) AS back FROM walk) WHERE back = 1"""

ROADS = f"""WITH RECURSIVE {D.HUBS}, h AS (SELECT destination_id::BIGINT AS trip_id, id, id * 7919 % 2000 AS y, id * 104729 % 2000 AS x, 10 + id % 4 * 5 AS visit, 8 + id % 5 AS open, CASE WHEN id % 7 = 0 THEN 24 ELSE 17 + id % 5 END AS close FROM hubs),
line AS (SELECT a.trip_id, a.id AS src, b.id AS dst, abs(a.y - b.y) * 11 + abs(a.x - b.x) * 8 AS m FROM h a JOIN h b ON a.trip_id = b.trip_id AND a.id <> b.id),
metres AS (SELECT trip_id, src, dst, m + (src * 31 + dst * 17) % 7 * 50 + 40 AS foot, m + (src * 13 + dst * 29) % 11 * 60 + 300 AS car FROM line),
legs AS (SELECT trip_id, src, dst, CASE WHEN foot / 1000.0::DOUBLE <= 1.2::DOUBLE THEN foot / 1000.0::DOUBLE ELSE car / 1000.0::DOUBLE END AS km,
  CASE WHEN foot / 1000.0::DOUBLE <= 1.2::DOUBLE THEN (foot * 4 // 5) / 60.0::DOUBLE ELSE (car // 7) / 60.0::DOUBLE + 8.0::DOUBLE END AS minutes FROM metres),
tour AS (SELECT trip_id, 1::BIGINT AS r, min(id) AS id, [min(id)] AS ids FROM h GROUP BY trip_id
  UNION ALL SELECT trip_id, r + 1, dst, list_append(ids, dst) FROM (SELECT t.trip_id, t.r, t.ids, l.dst, row_number() OVER (PARTITION BY t.trip_id ORDER BY l.km, l.dst) AS k
    FROM tour t JOIN legs l ON l.trip_id = t.trip_id AND l.src = t.id AND NOT list_contains(t.ids, l.dst)) WHERE k = 1),
walk AS (SELECT trip_id, 0::BIGINT AS r, NULL::BIGINT AS here, 9.0::DOUBLE AS clock, 0.0::DOUBLE AS km, 0::BIGINT AS seq, NULL::BIGINT AS id, NULL::DOUBLE AS arrival FROM h GROUP BY trip_id
  UNION ALL SELECT trip_id, r, CASE WHEN fits THEN nid ELSE here END, CASE WHEN fits THEN finish ELSE clock END, CASE WHEN fits THEN km + leg ELSE km END, CASE WHEN fits THEN seq + 1 ELSE seq END, CASE WHEN fits THEN nid END, CASE WHEN fits THEN arrival END
  FROM (SELECT *, there < close AND (finish - 9.0::DOUBLE) * 60 <= 480 AS fits FROM (SELECT *, greatest(there, open::DOUBLE) AS arrival, greatest(there, open::DOUBLE) + visit / 60.0::DOUBLE AS finish
    FROM (SELECT w.trip_id, t.r, w.here, w.clock, w.km, w.seq, t.id AS nid, coalesce(l.km, 0.0::DOUBLE) AS leg, w.clock + coalesce(l.minutes, 0.0::DOUBLE) / 60.0::DOUBLE AS there, h.visit, h.open, h.close
      FROM walk w JOIN tour t ON t.trip_id = w.trip_id AND t.r = w.r + 1 JOIN h ON h.trip_id = t.trip_id AND h.id = t.id LEFT JOIN legs l ON l.trip_id = w.trip_id AND l.src = w.here AND l.dst = t.id)))),
ends AS (SELECT trip_id, max(km) AS km, max(clock) AS clock FROM walk GROUP BY trip_id)
SELECT w.trip_id, seq::INT AS seq, id, round(arrival, 6) AS arrival, round(w.clock, 6) AS finish, {D.half_even('e.km', 2)} AS day_km, trunc((e.clock - 9.0::DOUBLE) * 60)::INT AS day_minutes,
  w.trip_id IN (SELECT trip_id FROM h GROUP BY trip_id HAVING count(*) > 1) AS on_roads FROM walk w JOIN ends e ON e.trip_id = w.trip_id WHERE id IS NOT NULL"""

SQL = {
    "road_itinerary": ROADS,
    "demand_monthly": f"WITH {D.DEMAND} SELECT * FROM demand",
    "demand_since": f"WITH {D.DEMAND} SELECT key, strftime(month, '%Y-%m') AS month, value FROM demand WHERE month >= DATE '1998-07-01'",
    "demand_spine": f"WITH {D.DEMAND}, {SPINE} SELECT key, month, value FROM filled",
    "crowding_zscore": f"WITH {D.DEMAND}, {Z} SELECT key, month, crowding_z, crowding_level FROM crowd",
    "holt_winters_fixed": HW,
    "best_months": f"""WITH {D.DEMAND}, {SPINE},
      stats AS (SELECT key, avg(y) AS mean, stddev_samp(y) AS std FROM filled GROUP BY key),
      season AS (SELECT key, month(month) AS m, avg(y) AS f FROM filled GROUP BY 1, 2),
      zz AS (SELECT key, m, round((f - mean) / nullif(std, 0), 6) AS z FROM season JOIN stats USING (key)),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY z ASC NULLS LAST, m) AS rank FROM zz)
      SELECT key, strftime(make_date(2002, m, 1), '%Y-%m') AS month, z AS crowding_z, {LEVEL.format(z='z')} AS crowding_level, rank::INT AS rank FROM ranked WHERE rank <= 3""",
    "best_forecast_months": f"""WITH {D.DEMAND}, {SPINE}, f AS ({HW}),
      stats AS (SELECT key, avg(y) AS mean, stddev_samp(y) AS std FROM filled GROUP BY key),
      zz AS (SELECT key, f.month AS month, round((forecast - mean) / nullif(std, 0), 6) AS z FROM f JOIN stats USING (key)),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY z ASC NULLS LAST, month) AS rank FROM zz)
      SELECT key, strftime(month, '%Y-%m') AS month, z AS crowding_z, {LEVEL.format(z='z')} AS crowding_level, rank::INT AS rank FROM ranked WHERE rank <= 3""",
    "travel_month": f"""WITH {D.DEMAND}, {SPINE}, h AS (SELECT key, month, coalesce(strftime(month, '%Y-%m') = '2001-' || lpad((key % 12 + 1)::VARCHAR, 2, '0'), false) AS month_matched FROM filled WHERE month >= DATE '2001-01-01')
      SELECT key, month, month_matched FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY month_matched DESC, month) AS r FROM h) WHERE r = 1""",
    "seasonal_naive_backtest": f"""WITH {D.DEMAND}, {SPINE}, m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY month DESC) <= 6 AS test FROM filled)
      SELECT a.key, round(avg(abs(b.y - a.y)), 4) AS mae, round(sqrt(avg((b.y - a.y) * (b.y - a.y))), 4) AS rmse FROM m a LEFT JOIN m b ON a.key = b.key AND NOT b.test AND b.month = (a.month - INTERVAL 12 MONTH)::DATE WHERE a.test GROUP BY a.key""",
    "centroid_classify": """WITH parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(generate_series(1, 64)) AS i FROM embeddings),
      c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM parts GROUP BY 1, 2) GROUP BY label),
      d AS (SELECT vec_id, c.label, round(list_distance(embedding::DOUBLE[], c.c), 6) AS distance FROM embeddings, c)
      SELECT vec_id, label, distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, label) AS rank FROM d) WHERE rank <= 3""",
    "majority_label": "SELECT key, name, n FROM (SELECT c_nationkey AS key, c_mktsegment AS name, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1",
    "destination_score": f"WITH {SCORED} SELECT * FROM scored",
    "best_destination": f"WITH {SCORED} SELECT key, score FROM scored ORDER BY score DESC, key LIMIT 1",
    "travel_mode_legs": f"""WITH {D.HUBS}, {PAIRS}, m AS (SELECT *, ['walking', 'driving', 'hybrid', 'walking'][(trip_id % 4 + 1)::INT] AS mode FROM pairs)
      SELECT trip_id, src, dst, round(km, 6) AS km, round({LEG.format(m='mode', km='km')}, 6) AS minutes FROM m""",
    "supplied_matrix_fallback": f"""WITH {D.HUBS}, {PAIRS}, w AS (SELECT trip_id, min(CASE WHEN trip_id % 2 = 0 OR src < dst THEN 1 ELSE 0 END) = 1 AS on_roads FROM pairs GROUP BY 1)
      SELECT trip_id, src, dst, round(CASE WHEN on_roads THEN 7.0::DOUBLE ELSE km END, 6) AS km, round(CASE WHEN on_roads THEN 42.0::DOUBLE ELSE km / 4.5::DOUBLE * 60 END, 6) AS minutes, on_roads FROM pairs JOIN w USING (trip_id)""",
    "day_schedule": DAY,
    "nn_tour": f"""WITH RECURSIVE {D.HUBS}, o AS (SELECT destination_id::BIGINT AS trip_id, id, lat, lon FROM hubs),
      walk AS (SELECT trip_id, 1::INT AS seq, min(id) AS id, [min(id)] AS ids FROM o GROUP BY trip_id
        UNION ALL SELECT trip_id, seq + 1, nid, list_append(ids, nid) FROM (SELECT w.trip_id, w.seq, w.ids, b.id AS nid, row_number() OVER (PARTITION BY w.trip_id ORDER BY {D.km('a.', 'b.')}, b.id) AS r
          FROM walk w JOIN o a ON a.trip_id = w.trip_id AND a.id = w.id JOIN o b ON b.trip_id = w.trip_id AND NOT list_contains(w.ids, b.id)) WHERE r = 1)
      SELECT trip_id, seq, id FROM walk""",
    "tour_length": f"""WITH {D.HUBS}, o AS (SELECT destination_id::BIGINT AS trip_id, id, lat, lon, row_number() OVER (PARTITION BY destination_id ORDER BY id) AS r FROM hubs)
      SELECT b.trip_id, round(coalesce(sum({D.km('a.', 'b.')}), 0.0::DOUBLE), 6) AS km FROM o b LEFT JOIN o a ON a.trip_id = b.trip_id AND a.r = b.r - 1 GROUP BY 1""",
    "meal_targets": """WITH p AS (SELECT n_nationkey AS key, n_nationkey % 4 + 1 AS meals, unnest(generate_series(1, n_nationkey % 4 + 1)) AS i FROM nation),
      h AS (SELECT key, (i - 1)::INT AS i, 9.0::DOUBLE + 8.0::DOUBLE * CASE WHEN meals <= 2 THEN [0.40::DOUBLE, 0.85::DOUBLE][i] ELSE i::DOUBLE / (meals + 1) END AS h FROM p)
      SELECT key, i, round(h, 6) AS hour, lpad(((round_even(h * 60, 0)::BIGINT // 60) % 24)::VARCHAR, 2, '0') || ':' || lpad((round_even(h * 60, 0)::BIGINT % 60)::VARCHAR, 2, '0') AS clock FROM h""",
    "meal_reserve": f"WITH {STOPS}, f AS (SELECT trip_id, list(visit ORDER BY visit) AS v FROM stops WHERE category = 'food' GROUP BY 1) SELECT trip_id, floor(least(2 * v[len(v) // 2 + 1] * 1.25::DOUBLE, 240.0::DOUBLE))::INT AS minutes FROM f",
    "open_now": f"WITH {STOPS}, s AS (SELECT *, CASE WHEN close < open THEN 24.0 ELSE close END AS c FROM stops) SELECT trip_id, count(*) FILTER (WHERE 9 >= open AND 9 < c) AS open_9, count(*) FILTER (WHERE 18 >= open AND 18 < c) AS open_18, count(*) FILTER (WHERE 23 >= open AND 23 < c) AS open_23 FROM s GROUP BY 1",
    "price_filter_fallback": f"WITH {D.PLACES}, s AS (SELECT destination_id, id, id % 4 AS price, destination_id % 3 - 1 AS most FROM places), g AS (SELECT *, max(CASE WHEN price <= most THEN 1 ELSE 0 END) OVER (PARTITION BY destination_id) AS ok FROM s) SELECT destination_id, id, price FROM g WHERE price <= most OR ok = 0",
    "empty_fallback": f"""WITH {D.PLACES}, found AS (SELECT destination_id, id FROM places WHERE destination_id % 2 = 0 AND category = 'museum'),
      ranked AS (SELECT destination_id, id, row_number() OVER (PARTITION BY destination_id ORDER BY id) AS r FROM places WHERE destination_id NOT IN (SELECT destination_id FROM found))
      SELECT * FROM found UNION ALL SELECT destination_id, id FROM ranked WHERE r <= 5""",
    "map_fit": f"""WITH {D.PLACES}, b AS (SELECT destination_id, min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM places GROUP BY 1),
      c AS (SELECT *, (s + n) / 2 AS lat, (w + e) / 2 AS lon FROM b)
      SELECT destination_id, round(least(16.0, least(log2(300 * 360.0::DOUBLE / 512 / greatest(e - w, 1e-6)), log2(460 * 360.0::DOUBLE / 512 * cos(radians(lat)) / greatest(n - s, 1e-6))) + log2(0.82::DOUBLE)), 6) AS zoom, round(lat, 6) AS lat, round(lon, 6) AS lon FROM c""",
    "bounding_boxes": f"WITH {D.HUBS} SELECT id, round(lat - 1500 / 111320.0::DOUBLE, 6) AS south, round(lon - 1500 / (111320.0::DOUBLE * cos(radians(lat))), 6) AS west, round(lat + 1500 / 111320.0::DOUBLE, 6) AS north, round(lon + 1500 / (111320.0::DOUBLE * cos(radians(lat))), 6) AS east FROM hubs",
    "clock_format": "WITH m AS (SELECT c_custkey, round_even((c_custkey * 37 % 2880) / 97.0::DOUBLE * 60, 0)::BIGINT AS m FROM customer) SELECT c_custkey, lpad((m // 60 % 24)::VARCHAR, 2, '0') || ':' || lpad((m % 60)::VARCHAR, 2, '0') AS clock FROM m",
    "month_format": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym, strftime(o_orderdate, '%B %Y') AS name FROM orders",
}
