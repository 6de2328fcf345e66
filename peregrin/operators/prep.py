"""Preparation of the place catalogue: dedupe, gates, diversification, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..functions.geo import haversine_km
from ..functions.scoring import fame, popularity_of_share

DRIFT_KM = 5.0


def dedupe_named(rows: DataFrame, by: list[str], name: str, preferred: Column, order: str) -> DataFrame:
    """One row per group and trimmed, lower-cased name: the first preferred one, else the first; it takes the place (position) of the first."""
    w = W.partitionBy(*by, F.lower(F.trim(F.col(name))))
    ranked = rows.withColumn("rn", F.row_number().over(w.orderBy(F.desc(preferred.cast("int")), F.asc(order)))).withColumn("position", F.min(order).over(w))
    return ranked.where("rn = 1").drop("rn")


def place_gate(rows: DataFrame, coordinates: DataFrame, max_km: float = DRIFT_KM) -> DataFrame:
    """Rows whose key, if they have one, is known and lies within max_km of its known coordinates.

    rows: key, lat, lon and more; coordinates: key, known_lat, known_lon. A key is
    judged as a whole: one bad row takes its key's others along.
    """
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("known_lat"), F.col("known_lon")) > max_km
    keyed = rows.where(F.col("key").isNotNull()).select("key", "lat", "lon").join(coordinates, "key", "left")
    rejected = keyed.where(F.col("known_lat").isNull() | F.col("known_lon").isNull() | far).select("key").distinct()
    return rows.join(rejected, "key", "left_anti")


def round_robin(rows: DataFrame, by: str, category: str, score: str, order: str, n: int) -> DataFrame:
    """n rows of each group, taken from its categories in turn: each category's best first, categories as they first appear."""
    inside = W.partitionBy(by, category)
    ranked = rows.withColumn("turn", F.row_number().over(inside.orderBy(F.desc(score), F.asc(order)))).withColumn("seen", F.min(order).over(inside))
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("turn", "seen", order))).where(F.col("rank") <= n).drop("seen")


def fame_popularity(rows: DataFrame, by: str, views: str, links: str) -> DataFrame:
    """rows with fame and popularity: the share of the group's scores not above their own, on the scale 2.5 to 5."""
    scored = rows.withColumn("fame", F.round(fame(F.col(views), F.col(links)), 9))
    share = F.cume_dist().over(W.partitionBy(by).orderBy("fame"))
    return scored.withColumn("popularity", popularity_of_share(share))


def fuzzy_matches(lines: DataFrame, names: DataFrame) -> DataFrame:
    """lines (line_id, line) with matched: whether some name lies in the line, or the line in a name, without regard to case.

    Of two texts that contain each other the longer has the first three letters
    of the shorter among its 3-letter pieces, so pairs meet on pieces only. Texts
    under three letters, which have no piece, are compared by their first letter.
    Equal lines are compared once.
    """

    def pieces(c: Column, n: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))

    a = lines.select(F.lower(F.trim("line")).alias("l")).where("length(l) > 0").distinct()
    b = names.select(F.lower(F.trim("name")).alias("n")).where("length(n) > 0").distinct()
    found = None
    for n, fits in ((3, lambda c: F.length(c) >= 3), (1, lambda c: F.length(c) < 3)):
        within = a.select("l", F.explode(pieces(F.col("l"), n)).alias("p")).join(b.where(fits(F.col("n"))).withColumn("p", F.substring("n", 1, n)), "p").where(F.col("l").contains(F.col("n")))
        around = a.where(fits(F.col("l"))).withColumn("p", F.substring("l", 1, n)).join(b.select("n", F.explode(pieces(F.col("n"), n)).alias("p")), "p").where(F.col("n").contains(F.col("l")))
        both = within.select("l").unionByName(around.select("l"))
        found = both if found is None else found.unionByName(both)
    hits = found.distinct().withColumn("hit", F.lit(True))
    return lines.withColumn("l", F.lower(F.trim("line"))).join(hits, "l", "left").select("line_id", "line", F.coalesce("hit", F.lit(False)).alias("matched"))


def build_places(elements: DataFrame, info: DataFrame) -> DataFrame:
    """Catalogue rows from map elements and what is known about their keys.

    elements: ord, destination_id, city, type, lat, lon, center, tags (a map).
    info: qid, description, summary, views, links. Elements without a name or a
    category are dropped.
    """
    e = elements.withColumn("category", T.classify_tags(F.col("tags"))).withColumn("name", F.col("tags")["name"]).where("category is not null and name is not null")
    e = e.withColumn("qid", T.normalize_qid(F.col("tags")["wikidata"])).join(info, "qid", "left")
    node = F.col("type") == "node"
    hours = T.opening_hours(F.col("tags")["opening_hours"])
    price = T.price_from_fee(F.col("tags")["fee"], F.col("tags")["charge"], T.category_default(F.col("category"), 1))
    summary, known = F.coalesce(F.length("summary"), F.lit(0)) > 0, F.coalesce(F.length("description"), F.lit(0)) > 0
    rows = e.select(
        "ord", "destination_id", "name", "category",
        F.round(F.when(node, F.col("lat")).otherwise(F.col("center")["lat"]), 6).alias("lat"), F.round(F.when(node, F.col("lon")).otherwise(F.col("center")["lon"]), 6).alias("lon"),
        T.category_default(F.col("category"), 0).alias("avg_visit_minutes"), price["level"].alias("price_level"), price["source"].alias("price_source"),
        F.when(summary, T.trim_description(F.col("summary"))).otherwise(T.describe(F.col("name"), F.col("city"), F.col("category"), F.col("description"))).alias("description"),
        F.when(summary, "wikipedia").when(known, "wikidata").otherwise("template").alias("description_source"),
        F.coalesce(hours["open"], T.category_default(F.col("category"), 2)).alias("open_hour"), F.coalesce(hours["close"], T.category_default(F.col("category"), 3)).alias("close_hour"),
        F.when(hours.isNotNull(), "osm").otherwise("category_default").alias("hours_source"),
        F.col("qid").alias("wikidata_qid"), F.col("links").alias("sitelink_count"), F.col("views").alias("monthly_pageviews"),
    )
    return fame_popularity(rows, "destination_id", "monthly_pageviews", "sitelink_count").withColumnRenamed("popularity", "popularity_score").drop("fame")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with poi_id POI0001, POI0002, ... in the given order.

    Rows are numbered within each value of the order's first column, and only
    the counts of these values (one row each) are summed up in one task.
    """
    first, *rest = order
    before = F.coalesce(F.sum("_n").over(W.orderBy("_first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(F.col(first).alias("_first")).agg(F.count("*").alias("_n")).select("_first", before.alias("_before"))
    within = rows.withColumn("_at", F.row_number().over(W.partitionBy(first).orderBy(*(rest or [first]))))
    joined = within.join(starts, F.col(first).eqNullSafe(F.col("_first")))
    return joined.withColumn("poi_id", F.format_string("POI%04d", F.col("_before") + F.col("_at"))).drop("_first", "_before", "_at")


def refresh_places(elements: DataFrame, info: DataFrame, coordinates: DataFrame, per_city: int = 150) -> DataFrame:
    """The whole preparation: dedupe, gate, diversify, build, number.

    elements as in build_places; coordinates: key (a Q-number), known_lat, known_lon.
    """
    tagged = elements.withColumn("key", T.normalize_qid(F.col("tags")["wikidata"])).withColumn("name", F.col("tags")["name"]).where("name is not null")
    tagged = tagged.withColumns({"_lat": F.when(F.col("type") == "node", F.col("lat")).otherwise(F.col("center")["lat"]), "_lon": F.when(F.col("type") == "node", F.col("lon")).otherwise(F.col("center")["lon"])})
    one = dedupe_named(tagged, ["destination_id"], "name", F.col("tags")["wikidata"].isNotNull(), "ord")
    gated = place_gate(one.select("key", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.struct(*one.columns).alias("row")), coordinates).select("row.*")
    known = gated.withColumn("category", T.classify_tags(F.col("tags"))).where("category is not null").join(info.select(F.col("qid").alias("key"), "views", "links"), "key", "left")
    scored = known.withColumn("fame", F.round(fame(F.col("views"), F.col("links")), 9))
    chosen = round_robin(scored, "destination_id", "category", "fame", "position", per_city)
    built = build_places(chosen.select("ord", "destination_id", "city", "type", "lat", "lon", "center", "tags"), info)
    return numbered(built, ["destination_id", "ord"])
