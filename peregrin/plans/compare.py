"""The comparison of retrieval configurations: queries by configurations, scored against a gold set and by a day's route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import evaluate as E, graph as G, retrieval as R
from ..session import cut, small_table
from . import demo as D
from .trip import route_trips

CONFIGS = ("fusion", "hybrid", "standard")
GOLD_KM = 6.0
#: Nations in the role of the cities.
CITIES = {"IST": 1, "PAR": 6, "ROM": 4, "BCN": 8, "AMS": 13, "PRG": 17, "VIE": 22, "LIS": 24}
# The 18 requests of the evaluation (city, archetype, category, query).
REQUESTS = [
    ("IST", "Culture Enthusiast", "landmark", "landmarks within walking distance of a transport hub"),
    ("PAR", "Culture Enthusiast", "museum", "museums close to a train station or airport"),
    ("ROM", "Culture Enthusiast", "museum", "museums near a transport hub for history lovers"),
    ("BCN", "Nightlife Seeker", "nightlife", "nightlife spots this traveler would enjoy"),
    ("AMS", "Nature & Adventure", "nature", "parks and nature spots near transport"),
    ("PRG", "Budget Backpacker", "nightlife", "cheap nightlife near the train station"),
    ("VIE", "Luxury Traveler", "shopping", "upscale shopping close to transport hubs"),
    ("LIS", "Beach & Relax", "beach", "relaxing beach spots reachable from the airport"),
    ("IST", "Family Traveler", "food", "we just arrived at the central station with heavy luggage and are starving, where can we get a quick meal without walking much?"),
    ("PAR", "Culture Enthusiast", "museum", "suitable places for the first day after a morning arrival"),
    ("ROM", "Culture Enthusiast", "history", "my elderly parents want to see historical monuments but cannot handle steep hills or long walks from the subway."),
    ("AMS", "Nightlife Seeker", "nightlife", "traveling on a tight budget and want to experience local nightlife that is safely accessible via late-night public transit."),
    ("BCN", "Luxury Traveler", "shopping", "we want to do a full day of luxury shopping and fine dining without needing to hail a taxi between locations."),
    ("LIS", "Nature & Adventure", "nature", "are there any quiet natural escapes in the city that are directly connected to the main train lines?"),
    ("VIE", "Culture Enthusiast", "culture", "where should we head for a relaxed evening out right after spending the entire afternoon at the main art gallery?"),
    ("PRG", "Budget Backpacker", "landmark", "we have a short layover in the city, what is the most iconic landmark we can realistically visit and still catch our flight?"),
    ("IST", "Culture Enthusiast", "history", "which neighborhoods offer the best mix of ancient architecture and modern cafes within a compact walking area?"),
    ("ROM", "Culture Enthusiast", "museum", "if we start our morning at the central square, what is a logical path to hit a museum and a local market before lunch?"),
]


def compare_configs(requests: DataFrame, places: DataFrame, hubs: DataFrame, documents: DataFrame, vectors: DataFrame, affinity: DataFrame, destinations: DataFrame, top_k: int = 8, mode: str = "walking") -> DataFrame:
    """config, query_id, n_gold, n_hit, recall, precision, grounded, km_per_stop.

    requests: query_id, destination_id, archetype, category, query, vector.
    documents and vectors: as for document_search. destinations: destination_id,
    lat, lon of the centres. The gold set is the category's places within 6 km of a hub. The standard configuration
    retrieves nothing and falls back to the city's first places, which count for
    precision and the route but aren't grounded.
    """
    routed = requests.withColumn("r", T.route_query(F.col("query"), F.col("archetype"))).select("query_id", "destination_id", "r.*")
    graph = G.graph_search(routed, places, hubs, affinity, 2 * top_k).select("query_id", F.lit("graph").alias("retriever"), "doc_id", "rank")
    lists = cut(graph.unionByName(R.document_search(requests, documents, vectors, 2 * top_k)))
    found = None
    for config in CONFIGS[:2]:
        part = R.reciprocal_rank_fusion(lists, top_k, config).select(F.lit(config).alias("config"), "query_id", "doc_id", "rank")
        found = part if found is None else found.unionByName(part)
    every = requests.select("query_id", "destination_id").join(F.broadcast(small_table(requests.sparkSession, [(c,) for c in CONFIGS], "config string")))
    lost = every.join(found.select("config", "query_id").distinct(), ["config", "query_id"], "left_anti")
    first = R.top(places.select("destination_id", F.col("id").alias("doc_id")), ["destination_id"], [F.asc("doc_id")], top_k)
    fallback = lost.join(first, "destination_id").select("config", "query_id", "doc_id", "rank")
    detail = places.select(F.col("id").alias("doc_id"), "category", "lat", "lon", "visit", "open", "close")
    hits = cut(found.withColumn("retrieved", F.lit(True)).unionByName(fallback.withColumn("retrieved", F.lit(False))).join(detail, "doc_id"))
    by = ["config", "query_id"]
    gold = requests.select("query_id", "destination_id", "category").join(G.nearest_hub(places, hubs, GOLD_KM).select("destination_id", "category", F.col("id").alias("doc_id")), ["destination_id", "category"]).select("query_id", "doc_id")
    none = every.select(*by).join(hits.where("retrieved").select(*by).distinct(), by, "left_anti").withColumn("doc_id", F.lit(-1).cast("long"))
    recall = E.recall(hits.where("retrieved").select(*by, "doc_id").unionByName(none.select(*by, "doc_id")), gold, by)
    liked = requests.select("query_id", "archetype").join(affinity.select("archetype", "category"), "archetype")
    precision = E.precision(hits, liked, by)
    grounded = hits.groupBy(*by).agg(F.max(F.when(F.col("retrieved"), 1.0).otherwise(0.0)).alias("grounded"))
    # A day's route for each request and configuration, from the city's centre and with meals.
    numbered = F.col("query_id") * 10 + F.array_position(F.array(*(F.lit(c) for c in CONFIGS)), F.col("config"))
    stops = cut(hits.withColumn("trip_id", numbered).select("trip_id", *by, F.col("doc_id").alias("id"), "lat", "lon", "category", "visit", "open", "close", F.lit("sight").alias("role")))
    kinds = cut(every.withColumn("trip_id", numbered).select("trip_id", "destination_id", F.lit(1).alias("days"), F.lit(480.0).alias("day_budget"), F.lit(mode).alias("mode")))
    centres = destinations.select("destination_id", F.col("lat").alias("hub_lat"), F.col("lon").alias("hub_lon"))
    days = route_trips(kinds, stops.drop(*by), places, centres).groupBy("trip_id").agg(F.max("day_km").alias("km"), F.count("*").alias("n_stops"))
    km = E.km_per_stop(stops.select("trip_id", *by).distinct().join(days, "trip_id", "left"), by)
    return recall.join(precision, by, "left").join(grounded, by, "left").join(km, by, "left")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    rows = [(i, CITIES[city], *rest) for i, (city, *rest) in enumerate(REQUESTS, 1)]
    requests = small_table(spark, rows, "query_id long, destination_id int, archetype string, category string, query string")
    return requests.join(D.query_vectors(spark, d).withColumnRenamed("vec_id", "query_id"), "query_id", "left")


def comparative_analysis(spark: SparkSession, d: str) -> DataFrame:
    places = D.places(spark, d).withColumns({"visit": F.lit(60), "open": F.lit(9), "close": F.lit(20)})
    lat, lon = D.coordinates("destination_id")
    centres = D.cities(spark, d).select("destination_id", lat.alias("lat"), lon.alias("lon"))
    return compare_configs(_requests(spark, d), places, D.hubs(spark, d), D.place_texts(spark, d), D.place_vectors(spark, d), G.affinity_table(spark), centres)


def comparative_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summarize(comparative_analysis(spark, d), ["recall", "precision", "grounded", "km_per_stop"], list(CONFIGS))


QUERIES = {f.__name__: f for f in (comparative_analysis, comparative_summary)}
SQL: dict[str, str] = {}
