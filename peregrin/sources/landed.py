"""Readers of saved responses of public services. Nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import normalize_qid, squeeze
from .tables import OSM_ELEMENT


def statistics_series(raw: DataFrame) -> DataFrame:
    """JSON-stat answers (key, body) -> key, month, value: the sparse value map joined with the time index; months in order of the index."""
    body = F.from_json("body", "value map<string,double>, dimension struct<time:struct<category:struct<index:map<string,int>>>>")
    parsed = raw.select("key", body.alias("b"))
    times = parsed.select("key", F.explode("b.dimension.time.category.index").alias("period", "place"))
    values = parsed.select("key", F.explode("b.value").alias("place", "value")).withColumn("place", F.col("place").cast("int"))
    return times.join(values, ["key", "place"]).select("key", F.to_date(F.col("period"), "yyyy-MM").alias("month"), F.col("value").cast("long").alias("value"))


def map_elements(raw: DataFrame) -> DataFrame:
    """Saved map queries (destination_id, body) -> elements; an answer with a remark is an error and gives a row in `remark`."""
    body = F.from_json("body", f"remark string, elements array<struct<{', '.join(f.replace(' ', ':', 1) for f in OSM_ELEMENT.split(', '))}>>")
    parsed = raw.select("destination_id", body.alias("b"))
    return parsed.select("destination_id", F.col("b.remark").alias("remark"), F.explode_outer("b.elements").alias("e")).select("destination_id", "remark", "e.*")


def article_coordinates(raw: DataFrame) -> DataFrame:
    """Saved title queries (body) -> title (as asked for), lat, lon: normalised titles are mapped back."""
    body = F.from_json("body", "query struct<normalized:array<struct<`from`:string,`to`:string>>, pages:map<string,struct<title:string,coordinates:array<struct<lat:double,lon:double>>>>>")
    parsed = raw.select(body.alias("b"))
    pages = parsed.select(F.explode(F.map_values("b.query.pages")).alias("p")).select("p.title", F.col("p.coordinates")[0].alias("c")).where("c is not null")
    renamed = parsed.select(F.explode("b.query.normalized").alias("n")).select(F.col("n.from").alias("asked"), F.col("n.to").alias("title"))
    return pages.join(renamed, "title", "left").select(F.coalesce("asked", "title").alias("title"), "c.lat", "c.lon")


def monthly_views(raw: DataFrame) -> DataFrame:
    """Saved view counts (title, body) -> title, views: the mean month, cut to a whole number."""
    body = F.from_json("body", "items array<struct<views:bigint>>")
    return raw.select("title", F.explode(body["items"]).alias("i")).groupBy("title").agg(F.avg("i.views").cast("int").alias("views"))


def summaries(raw: DataFrame) -> DataFrame:
    """Saved summaries (title, body) -> title, summary with white space collapsed; empty ones are null."""
    text = squeeze(F.from_json("body", "extract string")["extract"])
    return raw.select("title", F.when(text != "", text).alias("summary"))


def entity_answers(raw: DataFrame) -> DataFrame:
    """Saved answers about entities (body: bindings of item, sitelinks and, maybe, itemDescription and articleName) -> qid, description, sitelinks, title.

    An entity that several answers name counts once, by its last row of all;
    answers that hold nothing give no rows.
    """
    cell = "struct<value:string>"
    body = F.from_json("body", f"results struct<bindings:array<struct<item:{cell},itemDescription:{cell},sitelinks:{cell},articleName:{cell}>>>")
    rows = raw.select(F.posexplode(body["results"]["bindings"]).alias("at", "b"), F.md5("body").alias("answer"))
    rows = rows.select("answer", "at", F.element_at(F.split("b.item.value", "/"), -1).alias("qid"), F.col("b.itemDescription.value").alias("description"), F.col("b.sitelinks.value").cast("int").alias("sitelinks"), F.col("b.articleName.value").alias("title"))
    return rows.where("qid is not null").groupBy("qid").agg(F.max_by(F.struct("description", "sitelinks", "title"), F.struct("answer", "at")).alias("r")).select("qid", "r.*")


def batches(keys: DataFrame, column: str, size: int) -> DataFrame:
    """chunk, keys: the distinct values of a column, in order, as many at a time as one request asks for.

    Chunks come from ranges of the sorted values, each cut on its own, so no
    task sees them all; the last chunk of a range may be short. Nulls ask for nothing.
    """
    ids = keys.select(F.col(column).alias("key")).where("key is not null").distinct()
    ranged = ids.repartitionByRange("key").sortWithinPartitions("key").withColumn("n", F.monotonically_increasing_id())
    # The id's upper part is the range, its lower 33 bits the place there.
    place = F.col("n").bitwiseAND((1 << 33) - 1)
    return ranged.groupBy(F.shiftright("n", 33).alias("part"), F.floor(place / size).alias("k")).agg(F.array_sort(F.collect_list("key")).alias("keys")).select(F.concat_ws("-", "part", "k").alias("chunk"), "keys")


def entity_chunks(keys: DataFrame, size: int = 400) -> DataFrame:
    """chunk, qids: the valid entities of a column `qid`, 400 to a query."""
    return batches(keys.select(normalize_qid(F.col("qid")).alias("qid")), "qid", size).withColumnRenamed("keys", "qids")


def title_chunks(titles: DataFrame, size: int = 50) -> DataFrame:
    """chunk, titles: the article titles of a column `title`, 50 to a query."""
    return batches(titles, "title", size).withColumnRenamed("keys", "titles")


def request_states(attempts: DataFrame, most: int = 4, first_wait: float = 5.0) -> DataFrame:
    """key, state, wait of each request in a log of attempts (key, at, status, body); status is null where no answer came.

    state: `answered` once any attempt has a readable JSON answer; `absent` if
    the last one says that there is none (a client error but 429), which isn't
    asked again; `given up` after `most` attempts; else `retry`, after `wait`
    seconds, twice as long with each attempt.
    """
    ok = F.coalesce((F.col("status") < 400) & F.try_parse_json("body").isNotNull(), F.lit(False))
    per = attempts.groupBy("key").agg(F.max(ok).alias("ok"), F.max_by("status", "at").alias("last"), F.count("*").alias("n"))
    absent = F.coalesce(F.col("last").between(400, 499) & (F.col("last") != 429), F.lit(False))
    state = F.when(F.col("ok"), "answered").when(absent, "absent").when(F.col("n") >= most, "given up").otherwise("retry")
    return per.select("key", state.alias("state"), F.when(state == "retry", F.lit(first_wait) * F.pow(F.lit(2.0), F.col("n") - 1)).alias("wait"))


LANDED = "key string, at bigint, status int, body string, state string"


def land(landed: DataFrame, attempts: DataFrame) -> DataFrame:
    """The landing table brought up to date: key, at, status, body, state; a row per key that any attempt was made for.

    landed: such a table, or an empty one; attempts: key, at, status, body, new
    ones since. A readable answer counts before any other outcome, and the newest
    of those; without one the newest attempt counts, so a key that is known to
    have no answer (`absent`) keeps its entry until one comes. state: answered,
    absent or failed. What is already there is read once and not parsed again;
    only the newest of a key's rows is kept.
    """
    ok = F.coalesce((F.col("status") < 400) & F.try_parse_json("body").isNotNull(), F.lit(False))
    none = F.coalesce(F.col("status").between(400, 499) & (F.col("status") != 429), F.lit(False))
    state = F.when(ok, "answered").when(none, "absent").otherwise("failed")
    new = attempts.select("key", F.col("at").cast("long").alias("at"), F.col("status").cast("int").alias("status"), "body", state.alias("state")).where("key is not null")
    every = landed.select("key", "at", "status", "body", "state").unionByName(new)
    best = F.max_by(F.struct("at", "status", "body", "state"), F.struct((F.col("state") == "answered").alias("ok"), "at", "state", "body"))
    return every.groupBy("key").agg(best.alias("r")).select("key", "r.at", "r.status", F.when(F.col("r.state") == "answered", F.col("r.body")).alias("body"), "r.state")


def to_ask(keys: DataFrame, landed: DataFrame) -> DataFrame:
    """The keys that a next round has to ask for: those without an entry that settles them, each once."""
    return keys.select("key").where("key is not null").distinct().join(landed.where("state in ('answered', 'absent')"), "key", "left_anti")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """path (file), body: saved responses as they lie in a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def road_matrix(raw: DataFrame, stops: DataFrame) -> DataFrame:
    """Saved distance tables (trip_id, profile, body) -> trip_id, src, dst, profile, km, minutes; stops: trip_id, place, id. A failed answer gives no rows."""
    body = F.from_json("body", "code string, distances array<array<double>>, durations array<array<double>>")
    ok = raw.select("trip_id", "profile", body.alias("b")).where("b.code = 'Ok' and b.distances is not null and b.durations is not null")
    rows = ok.select("trip_id", "profile", F.posexplode(F.arrays_zip("b.distances", "b.durations")).alias("i", "r")).select("trip_id", "profile", "i", F.posexplode(F.arrays_zip("r.distances", "r.durations")).alias("j", "c"))
    a = stops.select("trip_id", F.col("place").alias("i"), F.col("id").alias("src"))
    b = stops.select("trip_id", F.col("place").alias("j"), F.col("id").alias("dst"))
    return rows.join(a, ["trip_id", "i"]).join(b, ["trip_id", "j"]).where("i <> j").select("trip_id", "src", "dst", "profile", (F.col("c.distances") / 1000).alias("km"), (F.col("c.durations") / 60).alias("minutes"))
