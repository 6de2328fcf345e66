"""Stand-ins: the driver's tables in the roles of cities, places, hubs, demand and vectors.

City = nation, place = customer (segment = category, balance = popularity),
hub = supplier, demand = monthly orders of a nation. Coordinates come from keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T

SEGMENTS = {"AUTOMOBILE": "shopping", "BUILDING": "landmark", "FURNITURE": "museum", "HOUSEHOLD": "food", "MACHINERY": "nature"}
#: What every third key of a segment is instead, so that all ten categories occur.
OTHERS = {"AUTOMOBILE": "nightlife", "BUILDING": "history", "FURNITURE": "culture", "HOUSEHOLD": "religion", "MACHINERY": "beach"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coordinates(key: str) -> tuple[Column, Column]:
    k = F.col(key).cast("long")
    return F.lit(40.0) + (k * 7919 % 2000) / F.lit(10000.0), F.lit(2.0) + (k * 104729 % 2000) / F.lit(10000.0)


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("destination_id"), F.col("n_name").alias("city"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = coordinates("c_custkey")
    third = F.col("c_custkey") % 3 == 0
    category = F.coalesce(*(F.when(F.col("c_mktsegment") == k, F.when(third, OTHERS[k]).otherwise(v)) for k, v in SEGMENTS.items()), F.lit("culture"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("destination_id"), F.col("c_name").alias("name"), category.alias("category"), lat.alias("lat"), lon.alias("lon"), F.col("c_acctbal").alias("popularity"))


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = coordinates("s_suppkey")
    category = F.element_at(F.array(*(F.lit(c) for c in SEGMENTS.values())), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("destination_id"), category.alias("category"), lat.alias("lat"), lon.alias("lon"), F.col("s_acctbal").alias("popularity"))


def place_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, destination_id, text: the places as documents."""
    p = places(spark, sf_dir).join(F.broadcast(cities(spark, sf_dir)), "destination_id")
    return p.select(F.col("id").alias("doc_id"), "destination_id", T.document_text(F.col("name"), F.col("category"), F.col("city"), F.lit("")).alias("text"))


def trip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, type, destination_id, text: places, and a guide for each city, whose number is negative."""
    places = place_texts(spark, sf_dir).withColumn("type", F.lit("poi"))
    key = F.col("destination_id").cast("long")
    guides = cities(spark, sf_dir).select((-key - 1).alias("doc_id"), F.lit("guide").alias("type"), "destination_id", F.concat(F.lit("A guide to "), "city", F.lit(": the best points of interest and experiences for every traveler")).alias("text"))
    return places.unionByName(guides)


def place_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, destination_id, embedding: the vector of a place is that of its id; a place without one is found by other means only."""
    own = places(spark, sf_dir).select(F.col("id").alias("vec_id"), "destination_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(own, "vec_id")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, vector: the vector of query q is that of vec_id q."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (nation), month, value (orders)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("month"))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("key"))
    # A customer's months are summed before the join, so the join moves sums and not orders.
    per = orders.groupBy("o_custkey", "month").agg(F.count("*").alias("n"))
    return per.join(own, "o_custkey").groupBy("key", "month").agg(F.sum("n").alias("value"))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as stops of one trip per nation, with visits and hours by key."""
    p = places(spark, sf_dir)
    k = F.col("id")
    return p.select(F.col("destination_id").cast("long").alias("trip_id"), "id", "lat", "lon", "category", (F.lit(30) + k % 4 * 15).cast("int").alias("visit"), (F.lit(8) + k % 3).cast("int").alias("open"), F.when(k % 7 == 0, 2).otherwise(F.lit(17) + k % 5).cast("int").alias("close"))


# The same in DuckDB's SQL.
COORDS = "40.0::DOUBLE + ({k} * 7919 % 2000) / 10000.0::DOUBLE AS lat, 2.0::DOUBLE + ({k} * 104729 % 2000) / 10000.0::DOUBLE AS lon"
PLACES = f"""places AS (SELECT c_custkey AS id, c_nationkey AS destination_id, c_name AS name,
  CASE c_mktsegment {" ".join(f"WHEN '{k}' THEN CASE WHEN c_custkey % 3 = 0 THEN '{OTHERS[k]}' ELSE '{v}' END" for k, v in SEGMENTS.items())} ELSE 'culture' END AS category,
  {COORDS.format(k="c_custkey")}, c_acctbal AS popularity FROM customer)"""
HUBS = f"""hubs AS (SELECT s_suppkey AS id, s_nationkey AS destination_id, ['shopping', 'landmark', 'museum', 'food', 'nature'][(s_suppkey % 5 + 1)::INT] AS category,
  {COORDS.format(k="s_suppkey")}, s_acctbal AS popularity FROM supplier)"""
DEMAND = """demand AS (SELECT c_nationkey AS key, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
HAVERSINE = "2 * 6371.0::DOUBLE * asin(sqrt((pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"


def km(a: str, b: str) -> str:
    return HAVERSINE.format(a=a, b=b)


def half_even(x: str, digits: int) -> str:
    """SQL that rounds a double as its binary value does, ties to even; x is named more than once, so it should be a column."""
    scale = f"{10**digits}.0::DOUBLE"
    high = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    over = f"(({x} * {scale} - floor({x} * {scale}) - 0.5::DOUBLE) + (({high} * {scale} - {x} * {scale}) + ({x} - {high}) * {scale}))"
    return f"((floor({x} * {scale}) + CASE WHEN {over} > 0 OR ({over} = 0 AND floor({x} * {scale}) % 2 <> 0) THEN 1 ELSE 0 END) / {scale})"
