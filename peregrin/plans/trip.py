"""A whole plan for a batch of trip requests: segment, destination, month, retrieval, route, narrative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scoring as S, text as T
from ..operators import cluster as C, forecast as FC, graph as G, retrieval as R, routing as RT
from ..operators.nearest import k_nearest
from ..session import cut, small_table
from . import demo as D
from .demand_routing import HW, HW_FORECAST, HW_RAW, LEVEL


def classify_requests(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """requests with archetype: that of the nearest profile (label, centroid) to their preferences; a missing one is 0.5."""
    vector = F.array(*(F.coalesce(F.col("preferences")[p], F.lit(S.NO_PREFERENCE)) for p in S.PREFERENCES))
    near = C.classify(requests.withColumn("_v", vector), profiles, "trip_id", "_v", 1)
    return requests.join(near.select("trip_id", F.col("label").alias("archetype")), "trip_id")


def choose_destination(requests: DataFrame, destinations: DataFrame, forecasts: DataFrame) -> DataFrame:
    """trip_id, destination_id: the one asked for, else the best by tags, budget and crowding in the travel month.

    destinations: destination_id, budget_level, tags, ord. forecasts: key, month,
    crowding_level and, optionally, crowding_z of the months to come. A month
    beyond the horizon means the first one, no month the one of least crowding.
    """
    pinned = requests.where(F.col("destination_id").isNotNull()).select("trip_id", "destination_id")
    free = requests.where(F.col("destination_id").isNull()).select("trip_id", "preferences", "travel_month")
    months = forecasts.select(F.col("key").alias("destination_id"), F.date_format("month", "yyyy-MM").alias("travel_month"), F.col("month"), "crowding_level", _z(forecasts))
    first = months.groupBy("destination_id").agg(F.min_by("crowding_level", "month").alias("first_level"), F.min_by("crowding_level", F.struct(F.col("z").isNull(), "z", "month")).alias("quiet_level"))
    # A trip meets each city once: with its level in the wanted month, or else in the first or quietest one.
    pairs = free.join(F.broadcast(destinations.join(first, "destination_id"))).join(months.drop("month", "z"), ["destination_id", "travel_month"], "left")
    level = F.when(F.col("travel_month").isNull(), F.col("quiet_level")).otherwise(F.coalesce("crowding_level", "first_level"))
    score = S.destination_score(S.tag_affinity(F.col("preferences"), F.col("tags")), S.budget_fit(F.col("budget_level"), F.col("preferences")["budget"]), S.crowd_penalty(level))
    best = R.top(pairs.withColumn("score", F.round(score, 9)), ["trip_id"], [F.desc_nulls_last("score"), F.asc("ord")], 1)
    return pinned.unionByName(best.select("trip_id", "destination_id"))


def _z(forecasts: DataFrame) -> Column:
    return (F.col("crowding_z") if "crowding_z" in forecasts.columns else F.lit(None).cast("double")).alias("z")


def candidate_places(requests: DataFrame, places: DataFrame, hubs: DataFrame, affinity: DataFrame, documents: DataFrame | None = None, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, config: str = "fusion") -> DataFrame:
    """trip_id, id, rank: retrieved places of each trip, at most max(12, 8 * days); the city's first ones where nothing is found.

    documents and vectors: as for document_search; without them there is the
    graph list only. Documents whose column `type`, if there is one, isn't poi
    (guides) are retrieved and fused with the others, and then left out.
    query_vectors: archetype and vector.
    """
    text = F.format_string("best %s points of interest and experiences", F.col("archetype"))
    q = requests.withColumn("r", T.route_query(text, F.col("archetype"))).select(F.col("trip_id").alias("query_id"), "destination_id", "r.*")
    most = requests.select("trip_id", F.greatest(F.lit(12), F.col("days") * 8).alias("most"))
    longest = most.agg(F.max("most")).first()[0] or 12
    lists = G.graph_search(q, places, hubs, affinity, 2 * longest).select("query_id", F.lit("graph").alias("retriever"), "doc_id", "rank")
    if documents is not None:
        asked = requests.select(F.col("trip_id").alias("query_id"), "archetype", "destination_id", text.alias("query"))
        lists = lists.unionByName(R.document_search(asked.join(query_vectors, "archetype", "left"), documents, vectors, 2 * longest))
    # Each retriever gives a trip twice what it keeps, however long the others are. What was found is read twice below.
    lists = cut(lists.join(most.withColumnRenamed("trip_id", "query_id"), "query_id").where("rank <= 2 * most").drop("most"))
    fused = R.reciprocal_rank_fusion(lists, longest, config).select(F.col("query_id").alias("trip_id"), F.col("doc_id").alias("id"), "rank")
    found = fused.join(most, "trip_id").where("rank <= most").select("trip_id", "id", "rank")
    if documents is not None and "type" in documents.columns:
        found = found.join(documents.where("type <> 'poi'").select(F.col("doc_id").alias("id")), "id", "left_anti").select("trip_id", "id", "rank")
    lost = requests.join(found.select("trip_id").distinct(), "trip_id", "left_anti").select("trip_id", "destination_id")
    first = R.top(places.select("destination_id", "id"), ["destination_id"], [F.asc("id")], longest)
    rest = lost.join(first, "destination_id").join(most, "trip_id").where("rank <= most").select("trip_id", "id", "rank")
    return found.unionByName(rest)


def narrative(days: DataFrame, names: DataFrame, requests: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """trip_id, text: whom the trip is for, the forecast, what was retrieved, and a line per day with its stops and times.

    requests: trip_id, archetype and, where known, what forecast_of adds. context:
    trip_id, id, rank of the places that the plan was made from.
    """
    stops = days.join(names.select("id", "name"), "id")
    line = F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("seq", "name", "arrival"))), lambda s: F.concat(s["name"], F.lit(" ("), T.clock(s["arrival"]), F.lit(")"))))
    per_day = stops.groupBy("trip_id", "day").agg(line.alias("line"))
    whole = per_day.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("day", "line"))).alias("d"))
    text = F.concat_ws("\n", F.transform("d", lambda x: F.concat(F.lit("Day "), x["day"].cast("string"), F.lit(": "), x["line"])))
    parts = [F.format_string("A trip for a %s traveler.", F.col("archetype"))]
    if {"city", "month", "crowding_level"} <= set(requests.columns):
        parts[0] = F.format_string("A trip for a %s traveler to %s.", F.col("archetype"), F.col("city"))
        parts.append(F.format_string("Forecast: %s crowding in %s.", F.coalesce("crowding_level", F.lit("unknown")), F.col("month")))
    if {"visitors", "quiet"} <= set(requests.columns):
        parts.append(F.concat(F.lit("About "), F.format_number("visitors", 0), F.lit(" visitors are expected.")))
        parts.append(F.concat(F.lit("The quietest months to come: "), F.concat_ws(", ", F.transform("quiet", lambda q: F.concat(F.date_format(q["month"], "MMMM yyyy"), F.lit(" ("), F.coalesce(q["crowding_level"], F.lit("unknown")), F.lit(")")))), F.lit(".")))
    out = requests.join(whole, "trip_id", "left")
    if context is not None:
        known = context.where("rank <= 6").join(names.select("id", "name", "category"), "id").withColumn("line", T.context_line(F.col("name"), F.col("category"), F.lit(None).cast("string"), F.col("reason") if "reason" in context.columns else F.lit(None).cast("string")))
        out = out.join(known.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("c")), "trip_id", "left")
        parts.append(F.concat(F.lit("Retrieved context:\n"), F.concat_ws("\n", F.transform("c", lambda x: F.concat(F.lit("- "), x["line"])))))
    return out.select("trip_id", F.concat_ws("\n", *parts, text).alias("text"))


#: What a request that doesn't say so gets: the dearest price level that it accepts, minutes a day, and how it travels.
REQUEST = {"max_price_level": ("int", 3), "day_budget": ("double", 480.0), "mode": ("string", "hybrid")}
#: What a plan depends on: requests that agree in all of it share one.
KIND = ["archetype", "destination_id", "days", *REQUEST]
MEALS_PER_DAY, DAY_START = 2, 9.0
#: Venues searched for around a sight at first: so many times what all meals of a trip and the tries of one may ask for.
FIRST_VENUES = 4


def with_defaults(requests: DataFrame, mode: str = "hybrid") -> DataFrame:
    """requests with every column of REQUEST, nulls filled."""
    for name, (kind, default) in (REQUEST | {"mode": ("string", mode)}).items():
        have = F.col(name) if name in requests.columns else F.lit(None)
        requests = requests.withColumn(name, F.coalesce(have.cast(kind), F.lit(default)))
    return requests


def useful_venues(food: DataFrame, n: int) -> DataFrame:
    """Of food places that lie at one point of a city and agree in visit and hours only the n of smallest id.

    On great circles they serve a meal alike, the smaller id first; a trip that
    places fewer than n of them, with the tries of a meal, never comes to the rest.
    """
    return R.top(food, ["destination_id", "lat", "lon", "visit", "open", "close"], [F.asc("id")], n).drop("rank")


def meal_venues(sights: DataFrame, kinds: DataFrame, food: DataFrame, centres: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """trip_id, id: the k food places nearest to each of a trip's sights and its city's centre, of those open at an hour at which it eats.

    And trip_id, id (-1: the centre), reach: how far around a sight all such
    places are among them. Their number follows the trip and not the city.
    """
    parts = F.array(*(F.lit(p) for p in RT.meal_parts(MEALS_PER_DAY)))
    hours = kinds.select("trip_id", "destination_id", F.explode(F.transform(parts, lambda p: F.lit(DAY_START) + p * F.col("day_budget") / F.lit(60.0))).alias("hour"))
    group = F.struct("destination_id", "hour").alias("g")
    at = hours.join(sights.select("trip_id", "id", "lat", "lon").unionByName(kinds.join(centres, "destination_id").select("trip_id", F.lit(-1).cast("long").alias("id"), F.col("hub_lat").alias("lat"), F.col("hub_lon").alias("lon"))), "trip_id").where("lat is not null")
    at = cut(at.select("trip_id", group, "id", "lat", "lon"))
    # Points are searched for once however many trips share them; a centre is known by its city.
    points = at.select("g", "id", "lat", "lon").distinct()
    open_ = hours.select("destination_id", "hour").distinct().join(food, "destination_id").where(RT.open_at(F.col("hour"), F.col("open"), F.col("close")))
    near = k_nearest(points, open_.select(group, "id", "lat", "lon"), k, "g")
    every = F.lit(float("inf"))
    reach = near.groupBy("g", F.col("src").alias("id")).agg(F.when(F.max("total") > k, F.max("km")).otherwise(every).alias("reach"))
    venues = at.join(near.select("g", F.col("src").alias("id"), "dst"), ["g", "id"]).select("trip_id", F.col("dst").alias("id")).distinct()
    return venues, at.join(reach, ["g", "id"], "left").groupBy("trip_id", "id").agg(F.min(F.coalesce("reach", every)).alias("reach"))


def route_trips(kinds: DataFrame, sights: DataFrame, places: DataFrame, centres: DataFrame, *, matrix: DataFrame | None = None, near_venues: bool = True) -> DataFrame:
    """Itineraries from each city's centre with two meals a day.

    kinds: trip_id, destination_id, days, day_budget, mode. sights: trip_id, id,
    lat, lon, visit, open, close, category, role of what was retrieved. Any food
    place of the city may serve a meal; one that was retrieved is a sight
    already, which itineraries can turn into a meal. matrix and near_venues: as
    for plan_trips.
    """
    detail = places.select("id", "lat", "lon", "category", "visit", "open", "close")
    food = places.where(F.col("category") == RT.FOOD)
    columns = ["trip_id", "id", "lat", "lon", "visit", "open", "close", "category", "role"]
    longest = kinds.agg(F.max("days")).first()[0] or 1
    typical = food.groupBy("destination_id").agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY coalesce(visit, {RT.VISIT_MINUTES}) DESC)").cast("double").alias("typical_meal"))
    own = kinds.select("trip_id", "destination_id", "days", F.col("day_budget").alias("budget"), "mode").join(centres, "destination_id").join(typical, "destination_id", "left").drop("destination_id")
    if matrix is not None:
        # The centre is a stop of its own where legs are looked up.
        hub = own.where("hub_lat is not null").select("trip_id", F.lit(-1).cast("long").alias("id"), F.col("hub_lat").alias("lat"), F.col("hub_lon").alias("lon"), F.lit("hub").alias("role"))

    else:
        # What a trip may have placed: a venue for each meal, and all its sights.
        most_sights = sights.groupBy("trip_id").count().agg(F.max("count")).first()[0] or 0
        food = cut(useful_venues(food, MEALS_PER_DAY * longest + RT.MEAL_TRIES + most_sights))

    def plan(left: DataFrame, k: int | None) -> DataFrame:
        """Itineraries of the kinds left, with the k venues nearest to each sight, or all."""
        mine = sights.join(left.select("trip_id"), "trip_id", "left_semi")
        if k is None:
            venues, reach = left.join(food.select("destination_id", "id"), "destination_id").select("trip_id", "id"), None
        else:
            venues, reach = meal_venues(mine, left, food, centres, k)
        meals = venues.join(mine.select("trip_id", "id"), ["trip_id", "id"], "left_anti").join(detail, "id").withColumn("role", F.lit("meal"))
        stops, trips, legs = mine.select(*columns).unionByName(meals.select(*columns)), own, None
        if reach is not None:
            stops = stops.join(reach, ["trip_id", "id"], "left")
            trips = own.join(reach.where("id = -1").select("trip_id", F.col("reach").alias("hub_reach")), "trip_id", "left")
        if matrix is not None:
            stops = stops.unionByName(hub.join(left.select("trip_id"), "trip_id", "left_semi"), allowMissingColumns=True)
            ends = stops.select("trip_id", "id")
            legs = left.select("trip_id", "destination_id").join(matrix, "destination_id").drop("destination_id")
            for end in ("src", "dst"):
                legs = legs.join(ends.withColumnRenamed("id", end), ["trip_id", end], "left_semi")
        return RT.itineraries(stops.join(trips, "trip_id"), meals_per_day=MEALS_PER_DAY, start=DAY_START, matrix=legs)

    days = None
    if near_venues:
        k, left = FIRST_VENUES * (MEALS_PER_DAY * longest + RT.MEAL_TRIES), kinds
        most = food.groupBy("destination_id").count().agg(F.max("count")).first()[0] or 0
        while k < most:
            got = cut(plan(left, k))
            days = got.where("settled") if days is None else days.unionByName(got.where("settled"))
            left = left.join(got.where("settled").select("trip_id").distinct(), "trip_id", "left_anti")
            if left.isEmpty():
                break
            k *= 4
        else:
            days = plan(left, None) if days is None else days.unionByName(plan(left, None))
    return (plan(kinds, None) if days is None else days).drop("settled")


def plan_trips(requests: DataFrame, *, profiles: DataFrame, destinations: DataFrame, forecasts: DataFrame, places: DataFrame, hubs: DataFrame, affinity: DataFrame, documents: DataFrame, vectors: DataFrame, query_vectors: DataFrame, config: str = "fusion", mode: str = "hybrid", matrix: DataFrame | None = None, near_venues: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: the itineraries, the requests with archetype and destination, and what was retrieved (trip_id, id, rank).

    requests: trip_id, preferences (a map), destination_id or null, travel_month
    (yyyy-MM) or null, days and, optionally, max_price_level (places over it are
    left out unless all are), day_budget (minutes) and mode. Days start from the
    city's centre where destinations has lat and lon. Requests that agree in all
    that a plan depends on share one, which is made once. forecasts: of the
    months that decide between destinations. matrix: destination_id, src, dst,
    profile, km, minutes on roads between places (and the centre, whose id is -1)
    of a city; a trip uses it where it holds all legs that it needs.
    near_venues: meals are looked for near the trip's sights, and again farther
    off for trips where that doesn't settle them; else in all its city at once.
    On roads the venues near by are those by great circles.
    """
    named = cut(with_defaults(classify_requests(requests, profiles), mode))
    full = cut(named.drop("destination_id").join(choose_destination(named, destinations, forecasts), "trip_id"))
    # A plan is known by the smallest of the trips that share it.
    kinds = cut(full.groupBy(*KIND).agg(F.min("trip_id").alias("trip_id")))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in KIND]
    shared = full.alias("f").join(kinds.alias("k"), same).select(F.col("f.trip_id").alias("trip"), F.col("k.trip_id").alias("trip_id"))
    ids = cut(candidate_places(kinds, places, hubs, affinity, documents, vectors, query_vectors, config))
    detail = places.select("id", "lat", "lon", "category", "visit", "open", "close", "price_level")
    price = kinds.select("trip_id", F.col("max_price_level").alias("most_price"))
    centres = destinations.select("destination_id", *((F.col(c) if c in destinations.columns else F.lit(None).cast("double")).alias(f"hub_{c}") for c in ("lat", "lon")))
    sights = cut(RT.within_budget(ids.join(detail, "id").join(price, "trip_id")).withColumn("role", F.lit("sight")))
    days = route_trips(kinds, sights, places, centres, matrix=matrix, near_venues=near_venues)
    out = lambda df: shared.join(df, "trip_id").drop("trip_id").withColumnRenamed("trip", "trip_id")
    return out(days), full, out(ids)


#: Months to come that decide between destinations, and that the traveler is told about.
FORECAST_MONTHS, TOLD_MONTHS, QUIET_MONTHS = 6, 12, 3
PROFILES = {
    "Culture Enthusiast": [0.5, 0.95, 0.3, 0.3, 0.4, 0.3], "Beach & Relax": [0.5, 0.3, 0.6, 0.3, 0.95, 0.3], "Budget Backpacker": [0.1, 0.5, 0.5, 0.6, 0.3, 0.7],
    "Luxury Traveler": [0.95, 0.6, 0.3, 0.4, 0.7, 0.2], "Nightlife Seeker": [0.6, 0.3, 0.2, 0.95, 0.3, 0.4], "Nature & Adventure": [0.3, 0.3, 0.95, 0.2, 0.3, 0.95], "Family Traveler": [0.5, 0.6, 0.6, 0.1, 0.6, 0.3],
}


def demo_requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for every user of events: preferences come from the user's events, the destination is free, price, budget and mode go by the user."""
    kinds, u = S.PREFERENCES, F.col("trip_id")
    ev = D.table(spark, d, "events").where("user_id is not null").groupBy(F.col("user_id").alias("trip_id"))
    kind = (F.ascii("event_type") + F.length("event_type")) % 6
    share = lambda i: (F.lit(0.2) + F.lit(0.7) * F.count_if(kind == i) / F.count("*")).alias(kinds[i])
    prefs = ev.agg(*(share(i) for i in range(6)))
    return prefs.select(
        "trip_id", F.create_map(*(x for k in kinds for x in (F.lit(k), F.col(k)))).alias("preferences"), F.lit(None).cast("int").alias("destination_id"), F.lit("2001-11").alias("travel_month"), F.lit(3).alias("days"),
        F.when(u % 5 == 0, 1).alias("max_price_level"), F.when(u % 7 == 0, 360.0).alias("day_budget"), F.when(u % 3 == 0, "walking").alias("mode"),
    )


def demo_tables(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables that plan_trips takes besides the requests, and the forecasts that the traveler is told about."""
    profiles = small_table(spark, list(PROFILES.items()), "label string, centroid array<double>")
    tags = F.array(F.element_at(F.array(*(F.lit(t) for t in S.TAG_PREFERENCE)), (F.col("destination_id") % len(S.TAG_PREFERENCE) + 1).cast("int")), F.lit("culture"))
    lat, lon = D.coordinates("destination_id")
    destinations = D.cities(spark, d).select("destination_id", "city", lat.alias("lat"), lon.alias("lon"), (F.col("destination_id") % 3 + 1).alias("budget_level"), tags.alias("tags"), F.col("destination_id").alias("ord"))
    series = D.demand(spark, d)
    filled = FC.month_spine(series).select("key", "month", F.coalesce("value", F.lit(0)).cast("double").alias("value"))
    told = cut(FC.crowding(FC.forecast_fixed(filled, TOLD_MONTHS), FC.history_stats(series), "forecast").select("key", "month", "forecast", "crowding_z", "crowding_level"))
    forecasts = R.top(told, ["key"], [F.asc("month")], FORECAST_MONTHS).drop("rank")
    p = D.places(spark, d)
    k = F.col("id")
    places = p.select("*", (F.lit(30) + k % 4 * 15).cast("int").alias("visit"), F.lit(9).alias("open"), (F.lit(18) + k % 4).cast("int").alias("close"), (k % 4).cast("int").alias("price_level"))
    order = small_table(spark, list(enumerate(PROFILES, 1)), "vec_id long, archetype string")
    of_archetype = D.query_vectors(spark, d).join(F.broadcast(order), "vec_id").select("archetype", "vector")
    return {"documents": D.trip_documents(spark, d), "vectors": D.place_vectors(spark, d), "query_vectors": of_archetype, "profiles": profiles, "destinations": destinations, "forecasts": forecasts, "places": places, "hubs": D.hubs(spark, d), "affinity": G.affinity_table(spark)}, told


def demo_plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, DataFrame], DataFrame]:
    """Itineraries, requests, retrieved places, the tables that they come from, and the forecasts to tell."""
    tables, told = demo_tables(spark, d)
    return *plan_trips(demo_requests(spark, d), **tables), tables, told


def plan_trip(spark: SparkSession, d: str) -> DataFrame:
    return demo_plan(spark, d)[0].drop("on_roads")


def plan_trip_requests(spark: SparkSession, d: str) -> DataFrame:
    """Archetype, destination and what the request accepts: all that a plan depends on, before any place is looked for."""
    tables, _ = demo_tables(spark, d)
    named = cut(with_defaults(classify_requests(demo_requests(spark, d), tables["profiles"])))
    where = choose_destination(named, tables["destinations"], tables["forecasts"])
    return named.drop("destination_id").join(where, "trip_id").select("trip_id", "archetype", "destination_id", "days", *REQUEST)


def forecast_of(requests: DataFrame, destinations: DataFrame, forecasts: DataFrame) -> DataFrame:
    """requests with city, month, crowding_level, visitors and quiet: what the forecast says of the travel month.

    forecasts: key, month, forecast, crowding_z, crowding_level of the months to
    come. A month beyond them means the first one, no month the one of least
    crowding. visitors is the forecast cut to a whole number, quiet an array of
    (month, crowding_level) of the three months of least crowding.
    """
    f = forecasts.withColumnRenamed("key", "destination_id")
    quiet = R.top(f, ["destination_id"], [F.asc_nulls_last("crowding_z"), F.asc("month")], QUIET_MONTHS)
    quiet = quiet.groupBy("destination_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "month", "crowding_level"))), lambda q: F.struct(q["month"].alias("month"), q["crowding_level"].alias("crowding_level"))).alias("quiet"))
    hit = F.coalesce(F.date_format("month", "yyyy-MM") == F.col("travel_month"), F.lit(False))
    asked = requests.select("destination_id", "travel_month").distinct().join(f, "destination_id")
    order = [F.desc("hit"), F.asc_nulls_last(F.when(F.col("travel_month").isNull(), F.col("crowding_z"))), F.asc("month")]
    one = R.top(asked.withColumn("hit", hit), ["destination_id", "travel_month"], order, 1)
    one = one.select(F.col("destination_id").alias("_d"), F.col("travel_month").alias("_m"), F.date_format("month", "yyyy-MM").alias("month"), "crowding_level", F.col("forecast").cast("long").alias("visitors"))
    known = requests.join(one, (F.col("destination_id") == F.col("_d")) & F.col("travel_month").eqNullSafe(F.col("_m")), "left").drop("_d", "_m")
    return known.join(quiet, "destination_id", "left").join(destinations.select("destination_id", "city"), "destination_id")


def trip_forecasts(spark: SparkSession, d: str) -> DataFrame:
    """What each traveler is told of the month and its alternatives; every fourth has no month in mind, every ninth one beyond the horizon."""
    tables, told = demo_tables(spark, d)
    u = F.col("trip_id")
    asked = demo_requests(spark, d).withColumn("destination_id", (u % 25).cast("int")).withColumn("travel_month", F.when(u % 4 == 0, None).when(u % 9 == 0, "2030-01").otherwise(F.col("travel_month")))
    r = forecast_of(asked, tables["destinations"], told)
    return r.select("trip_id", "city", "month", "crowding_level", "visitors", F.concat_ws(",", F.transform("quiet", lambda q: F.concat(F.date_format(q["month"], "yyyy-MM"), F.lit(":"), q["crowding_level"]))).alias("quiet"))


def plan_trip_narrative(spark: SparkSession, d: str) -> DataFrame:
    days, full, ids, tables, told = demo_plan(spark, d)
    return narrative(days, tables["places"], forecast_of(full, tables["destinations"], told), ids)


QUERIES = {f.__name__: f for f in (plan_trip, plan_trip_requests, trip_forecasts, plan_trip_narrative)}

# ------------------------------------------------------------------------ SQL

_LIKES = [f"0.2::DOUBLE + 0.7::DOUBLE * count(*) FILTER (WHERE (ascii(event_type) + length(event_type)) % 6 = {i}) / count(*) AS {p}" for i, p in enumerate(S.PREFERENCES)]
REQUESTS = f"req AS (SELECT user_id AS trip_id, {', '.join(_LIKES)} FROM events WHERE user_id IS NOT NULL GROUP BY 1)"
_TAGS = list(S.TAG_PREFERENCE)


def _sql() -> dict[str, str]:
    told = f"""hw AS ({HW.replace(HW_FORECAST, HW_RAW)}),
      hist AS (SELECT key, avg(value) AS mean, stddev_samp(value) AS std FROM demand GROUP BY key),
      zz AS (SELECT hw.key, hw.month, forecast, round((forecast - mean) / nullif(std, 0), 6) AS z FROM hw JOIN hist ON hist.key = hw.key),
      told AS (SELECT key, month, forecast, z, {LEVEL.format(z='z')} AS level, row_number() OVER (PARTITION BY key ORDER BY month) AS h FROM zz)"""
    profiles = ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', [{', '.join(f'{x}::DOUBLE' for x in v)}])" for n, v in PROFILES.items())
    pref = "CASE tag " + " ".join(f"WHEN '{t}' THEN {p}" for t, p in S.TAG_PREFERENCE.items()) + " END"
    return {
        "plan_trip_requests": f"""WITH {D.DEMAND}, {told}, {REQUESTS},
          prof(label, c) AS (VALUES {profiles}),
          near AS (SELECT r.*, label AS archetype, row_number() OVER (PARTITION BY trip_id ORDER BY round(list_distance([{', '.join(S.PREFERENCES)}], c), 6), label) AS k FROM req r, prof),
          dest AS (SELECT n_nationkey AS destination_id, n_nationkey % 3 + 1 AS level, unnest([{', '.join(f"'{t}'" for t in _TAGS)}, 'x'][(n_nationkey % {len(_TAGS)} + 1)::INT : (n_nationkey % {len(_TAGS)} + 1)::INT] || ['culture']) AS tag FROM nation),
          crowd AS (SELECT key, coalesce(max(CASE WHEN strftime(month, '%Y-%m') = '2001-11' THEN level END), min_by(level, month)) AS crowding FROM told WHERE h <= 6 GROUP BY key),
          liked AS (SELECT trip_id, destination_id, any_value(level) AS level, any_value(budget) AS budget, avg({pref}) AS a FROM near, dest WHERE k = 1 GROUP BY 1, 2),
          scored AS (SELECT trip_id, destination_id, round(0.5::DOUBLE * a + 0.3::DOUBLE * (1.0::DOUBLE - abs(level - (budget * 2 + 1)) / 2.0::DOUBLE) - CASE crowding WHEN 'low' THEN 0.0::DOUBLE WHEN 'medium' THEN 0.15::DOUBLE WHEN 'high' THEN 0.35::DOUBLE END, 9) AS score FROM liked JOIN crowd ON key = destination_id),
          best AS (SELECT trip_id, destination_id, row_number() OVER (PARTITION BY trip_id ORDER BY score DESC NULLS LAST, destination_id) AS k FROM scored)
          SELECT n.trip_id, archetype, b.destination_id, 3 AS days, CASE WHEN n.trip_id % 5 = 0 THEN 1 ELSE 3 END AS max_price_level, CASE WHEN n.trip_id % 7 = 0 THEN 360.0::DOUBLE ELSE 480.0::DOUBLE END AS day_budget, CASE WHEN n.trip_id % 3 = 0 THEN 'walking' ELSE 'hybrid' END AS mode
          FROM near n JOIN best b ON n.trip_id = b.trip_id AND n.k = 1 AND b.k = 1""",
        "trip_forecasts": f"""WITH {D.DEMAND}, {told},
          asked AS (SELECT DISTINCT user_id AS trip_id, (user_id % 25)::INT AS key, CASE WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 9 = 0 THEN '2030-01' ELSE '2001-11' END AS wanted FROM events WHERE user_id IS NOT NULL),
          picked AS (SELECT trip_id, key, month, level, forecast, row_number() OVER (PARTITION BY trip_id ORDER BY coalesce(strftime(month, '%Y-%m') = wanted, false) DESC, CASE WHEN wanted IS NULL THEN z END NULLS LAST, month) AS k FROM asked JOIN told USING (key)),
          quiet AS (SELECT key, string_agg(strftime(month, '%Y-%m') || ':' || level, ',' ORDER BY r) AS quiet FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY z NULLS LAST, month) AS r FROM told) WHERE r <= 3 GROUP BY key)
          SELECT a.trip_id, n_name AS city, strftime(p.month, '%Y-%m') AS month, level AS crowding_level, trunc(forecast)::BIGINT AS visitors, coalesce(quiet, '') AS quiet
          FROM asked a JOIN nation ON n_nationkey = a.key LEFT JOIN picked p ON p.trip_id = a.trip_id AND p.k = 1 LEFT JOIN quiet q ON q.key = a.key""",
    }


SQL: dict[str, str] = _sql()
