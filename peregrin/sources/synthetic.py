"""Generated tables for demonstrations and tests.

Random numbers are a hash of seed, key and draw, so a row has the same values
however the table is dealt out, in each attempt of a task, and in any engine that
knows MD5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import CATEGORY_DEFAULTS, category_default
from ..session import small_table


def uniform(seed: int, key: Column, draw: str) -> Column:
    """A number over 0 and up to 1: 32 bits of a hash of seed, key and the draw's name."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(draw)))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(1.0)) / F.lit(2.0**32)


def normal(seed: int, key: Column, draw: str) -> Column:
    """A standard normal number, from two uniform ones by their polar angle."""
    return F.sqrt(F.lit(-2.0) * F.ln(uniform(seed, key, f"{draw}/r"))) * F.cos(F.lit(2.0 * math.pi) * uniform(seed, key, f"{draw}/a"))


def answers(respondents: DataFrame, profiles: dict[str, dict[str, float]], spread: float = 0.12, seed: int = 42) -> DataFrame:
    """respondents (id, archetype) with an answer per dimension, scattered normally about their archetype's profile and clipped to 0..1."""
    names = list(next(iter(profiles.values())))
    base = small_table(respondents.sparkSession, [(a, *(p[n] for n in names)) for a, p in profiles.items()], "archetype string, " + ", ".join(f"{n} double" for n in names))
    value = lambda n: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(n) + F.lit(spread) * normal(seed, F.col("id"), n)))
    return respondents.join(F.broadcast(base), "archetype").select("id", "archetype", *(value(n).alias(n) for n in names))


def survey(spark: SparkSession, profiles: dict[str, dict[str, float]], per_archetype: int = 60, spread: float = 0.12, seed: int = 42) -> DataFrame:
    """As many answers for each archetype."""
    kinds = F.array(*(F.lit(a) for a in profiles))
    who = spark.range(len(profiles) * per_archetype).select("id", kinds[(F.col("id") % len(profiles)).cast("int")].alias("archetype"))
    return answers(who, profiles, spread, seed)


def scattered_places(cities: DataFrame, per_city: int = 150, spread: float = 0.03, seed: int = 42) -> DataFrame:
    """Places scattered about their city's centre, with a category in turn."""
    rows = cities.select("destination_id", "city", F.col("lat").alias("y"), F.col("lon").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(per_city))).alias("i"))
    kinds = F.array(*(F.lit(c) for c in sorted(CATEGORY_DEFAULTS)))
    key = F.concat_ws("-", F.col("destination_id").cast("string"), F.col("i").cast("string"))
    rows = rows.withColumn("category", kinds[F.pmod(F.col("i"), F.lit(len(CATEGORY_DEFAULTS)))]).withColumn("poi_id", key)
    value = lambda k: category_default(F.col("category"), k)
    at = lambda c, name: F.col(c) + normal(seed, F.col("poi_id"), name) * F.lit(spread)
    popularity = F.round(uniform(seed, F.col("poi_id"), "popularity") * 2.5 + 2.5, 2)
    return rows.select("poi_id", "destination_id", F.concat_ws(" ", "city", "category", F.col("i").cast("string")).alias("name"), "category", at("y", "lat").alias("lat"), at("x", "lon").alias("lon"), value(0).alias("avg_visit_minutes"), value(1).alias("price_level"), popularity.alias("popularity_score"), value(2).alias("open_hour"), value(3).alias("close_hour"))


#: Fixed values: (first month, last month, share of the demand that is left).
SHOCKS = [("2020-03-01", "2021-05-01", 0.08), ("2021-06-01", "2022-06-01", 0.5)]


def demand(spark: SparkSession, cities: DataFrame, months: int = 89, seed: int = 42) -> DataFrame:
    """destination_id, month, visitors: trend, season, shocks and noise."""
    rows = cities.select("destination_id", F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("t"))
    rows = rows.withColumn("month", F.add_months(F.lit("2019-01-01").cast("date"), F.col("t")))
    season = F.lit(1.0) + F.lit(0.35) * F.sin(F.col("t") * 2 * math.pi / 12)
    left = F.coalesce(*(F.when(F.col("month").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(x)) for a, b, x in SHOCKS), F.lit(1.0))
    noise = normal(seed, F.concat_ws("/", F.col("destination_id").cast("string"), F.col("t").cast("string")), "noise")
    visitors = (F.lit(100000) + F.col("t") * 500) * season * left * (F.lit(1.0) + noise * 0.05)
    return rows.select("destination_id", "month", F.greatest(F.lit(0).cast("long"), visitors.cast("long")).alias("visitors"))
