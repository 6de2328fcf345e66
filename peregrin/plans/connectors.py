"""Queries of sources and sinks: tables written and read again, saved answers parsed, places built from map elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import graph as G, prep as P
from ..session import shared_path
from ..sources import landed as L, tables as TB
from . import demo as D
from .prep_eval import HOURS, PATTERN, TAG_SETS, _at, _case, _pick

KINDS = ["airport", "train_station"]
STATUS = [200, 404, 429, 503, None]


def _reread(spark: SparkSession, df: DataFrame, table: str) -> DataFrame:
    """df written as CSV and read again by the schema of the table named."""
    path = shared_path(spark, table)
    TB.write_table(df, path, "csv")
    return TB.read_csv(spark, path, table)


def transport_csv(spark, d):
    k = F.col("id")
    hubs = D.hubs(spark, d).select(F.concat(F.lit("T"), k).alias("transport_id"), F.concat(F.lit("N"), "destination_id").alias("destination_id"), F.format_string('Hub "%d", north', k).alias("name"), _pick(KINDS, k).alias("type"), "lat", "lon")
    return _reread(spark, hubs, "transport")


def destinations_csv(spark, d):
    """Cities with their tags as JSON text, whose quotes CSV doubles."""
    k = F.col("n_nationkey")
    tags = F.to_json(F.array(F.lower("n_name"), F.concat(F.lit("t"), k % 3)))
    rows = D.table(spark, d, "nation").select(F.concat(F.lit("N"), k).alias("destination_id"), F.col("n_name").alias("city"), F.concat(F.lit("R"), "n_regionkey").alias("country"), (k + 0.5).cast("double").alias("lat"), (k + 0.25).cast("double").alias("lon"), (k % 3 + 1).cast("int").alias("budget_level"), tags.alias("tags"))
    return _reread(spark, rows, "destinations").select("destination_id", "city", "country", "lat", "lon", "budget_level", F.posexplode("tags").alias("at", "tag"))


def survey_csv(spark, d):
    share = lambda n: (F.col("c_custkey") % n / F.lit(float(n))).alias
    rows = D.table(spark, d, "customer").select(F.initcap("c_mktsegment").alias("archetype"), *(share(n)(c) for n, c in enumerate(("budget", "culture", "nature", "nightlife", "relax", "adventure"), 2)))
    return _reread(spark, rows, "user_survey").groupBy("archetype").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("budget", "adventure")))


def demand_refresh(spark, d):
    """Answers in JSON-stat form, one per nation with its months (a bounded number), parsed, written and read by date."""
    place = F.months_between("month", F.lit("1990-01-01").cast("date")).cast("int").cast("string")
    period = F.date_format("month", "yyyy-MM")
    per = D.demand(spark, d).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(place, "value"))).alias("value"), F.map_from_entries(F.collect_list(F.struct(period, place.cast("int")))).alias("index"))
    body = F.to_json(F.struct("value", F.struct(F.struct(F.struct("index").alias("category")).alias("time")).alias("dimension")))
    series = L.statistics_series(per.select("key", body.alias("body")))
    return _reread(spark, series.select(F.col("key").cast("string").alias("destination_id"), F.col("month").alias("date"), F.col("value").alias("visitors")), "demand_timeseries")


def text_lines(spark, d):
    """Texts written as text files and read again: each line, and how often it stands."""
    path = shared_path(spark, "lines")
    TB.write_table(D.table(spark, d, "benchmark").select("text"), path, "text")
    return spark.read.text(path).groupBy(F.md5("value").alias("line")).agg(F.count("*").alias("n"))


def edges_by_relation(spark, d):
    """Two relations written as the graph's edges, and one of them read back from its own folder."""
    path = shared_path(spark, "edges")
    cities = D.cities(spark, d)
    edges = G.contains_edges(cities, D.places(spark, d), "HAS_POI").unionByName(G.contains_edges(cities, D.hubs(spark, d), "HAS_TRANSPORT"))
    TB.write_edges(edges.select("src", "dst", "relation"), path)
    return TB.read_edges(spark, path, "HAS_TRANSPORT").select("src", "dst", F.col("relation").cast("string").alias("relation"))


def _tags(k: Column, name: Column) -> Column:
    """A place's tags by its key: name, a kind, hours, fee, charge and an entity; some are missing."""
    return F.map_concat(
        F.create_map(F.lit("name"), name, F.lit("opening_hours"), _pick(HOURS, k), F.lit("fee"), _pick(["no", "yes", None, "donation"], k), F.lit("charge"), _pick([None, "5 EUR", ""], k)),
        F.create_map(F.lit("wikidata"), F.when(k % 3 != 0, F.concat(F.lit("Q"), k % 50)), _pick([a for a, _ in TAG_SETS], k), _pick([b for _, b in TAG_SETS], k)),
    )


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """Customers as map elements; every second one is an area, known by its centre."""
    k, node = F.col("id"), F.col("id") % 2 == 0
    p = D.places(spark, d).join(F.broadcast(D.cities(spark, d)), "destination_id")
    return p.select(k.alias("ord"), "destination_id", "city", F.when(node, "node").otherwise("way").alias("type"), F.when(node, F.col("lat")).alias("lat"), F.when(node, F.col("lon")).alias("lon"), F.when(~node, F.struct("lat", "lon")).alias("center"), _tags(k, F.when(k % 13 != 0, F.concat(F.lit("Place "), (k % 40).cast("string")))).alias("tags"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """A saved map query per customer, parsed; every eleventh is a remark, that is an error."""
    body = F.when(F.col("ord") % 11 == 0, F.lit('{"remark": "timeout", "elements": []}')).otherwise(F.to_json(F.struct(F.array(F.struct("type", F.col("ord").alias("id"), "lat", "lon", "center", "tags")).alias("elements"))))
    return L.map_elements(_elements(spark, d).select("destination_id", body.alias("body")))


def map_answers(spark, d):
    return _parsed(spark, d).select("destination_id", "remark", "type", "id", F.coalesce("lat", "center.lat").alias("y"), F.coalesce("lon", "center.lon").alias("x"), F.col("tags")["name"].alias("name"), F.col("tags")["wikidata"].alias("entity"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    """The elements of all answers that aren't errors, with their city."""
    return _parsed(spark, d).where("remark is null").withColumnRenamed("id", "ord").drop("remark").join(F.broadcast(D.cities(spark, d)), "destination_id")


def _entity_bodies(spark: SparkSession, d: str) -> DataFrame:
    """An answer about two entities per supplier; every fourth has no article, every seventh answer is empty."""
    k = F.col("s_suppkey")
    cell = lambda x: F.struct(x.cast("string").alias("value"))
    at = lambda i: F.struct(cell(F.concat(F.lit("http://e/Q"), k * 2 + i)).alias("item"), F.when((k + i) % 3 != 0, cell(F.concat(F.lit("kind "), k % 5))).alias("itemDescription"), cell(k % 60).alias("sitelinks"), F.when(k % 4 != 0, cell(F.concat(F.lit("Title "), k * 2 + i))).alias("articleName"))
    found = F.when(k % 7 != 0, F.array(at(0), at(1))).otherwise(F.array().cast("array<struct<item:struct<value:string>,itemDescription:struct<value:string>,sitelinks:struct<value:string>,articleName:struct<value:string>>>"))
    return D.table(spark, d, "supplier").select(F.to_json(F.struct(F.struct(found.alias("bindings")).alias("results"))).alias("body"))


def entity_lookup(spark, d):
    return L.entity_answers(_entity_bodies(spark, d))


def entity_batches(spark, d):
    """The entities that map elements name, each in one query of at most 400."""
    raw = _elements(spark, d).select(F.concat(F.col("tags")["wikidata"], F.lit("; Q0")).alias("qid"))
    c = L.entity_chunks(raw)
    return c.select(F.explode("qids").alias("qid"), (F.size("qids") <= 400).alias("fits"))


def title_batches(spark, d):
    c = L.title_chunks(entity_lookup(spark, d))
    return c.select(F.explode("titles").alias("title"), (F.size("titles") <= 50).alias("fits"))


def titled_without_info(spark, d):
    """Articles named by entities that no summary was fetched for."""
    summaries = L.summaries(D.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("Title "), F.col("s_suppkey") * 2).alias("title"), F.lit('{"extract": "A place."}').alias("body")))
    return entity_lookup(spark, d).where("title is not null").select("title").join(summaries, "title", "left_anti")


def article_coordinates(spark, d):
    """A saved title query per supplier: asked with an underscore, answered with a blank; every fifth has no coordinates."""
    k = F.col("id")
    page = F.struct(F.concat(F.lit("Hub "), k).alias("title"), F.when(k % 5 != 0, F.array(F.struct("lat", "lon"))).alias("coordinates"))
    renamed = F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit("Hub_"), k).alias("from"), F.concat(F.lit("Hub "), k).alias("to"))))
    body = F.to_json(F.struct(F.struct(renamed.alias("normalized"), F.create_map(k.cast("string"), page).alias("pages")).alias("query")))
    return L.article_coordinates(D.hubs(spark, d).select(body.alias("body"))).select("title", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def monthly_views(spark, d):
    """A saved view count per user: the events of each day, their mean cut to a whole number."""
    days = D.table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("views"))
    body = F.to_json(F.struct(F.collect_list(F.struct("views")).alias("items")))
    return L.monthly_views(days.groupBy("user_id").agg(body.alias("body")).select(F.concat(F.lit("User "), "user_id").alias("title"), "body"))


def article_summaries(spark, d):
    raw = D.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("title"), F.to_json(F.struct(F.col("text").alias("extract"))).alias("body"))
    return L.summaries(raw).select("title", F.length("summary").cast("long").alias("n"), F.md5("summary").alias("digest"))


def request_log(spark, d):
    """Events as attempts at a request per user and day: what came of each, and how long the next one waits."""
    e = F.col("event_id")
    log = D.table(spark, d, "events").select(F.concat_ws("/", "user_id", F.to_date("ts")).alias("key"), e.alias("at"), _pick(STATUS, e).cast("int").alias("status"), F.when(e % 7 == 0, "{").otherwise('{"a": 1}').alias("body"))
    return L.request_states(log)


def _info(spark: SparkSession, d: str) -> DataFrame:
    """What is known about an entity, one per supplier: a kind, a summary, views or links; each may be missing."""
    k = F.col("s_suppkey")
    return D.table(spark, d, "supplier").select(F.concat(F.lit("Q"), k).alias("qid"), F.when(k % 3 != 0, F.concat(F.lit("kind "), k)).alias("description"), F.when(k % 4 == 0, F.concat(F.lit("Known since "), k + 1000, F.lit("."))).alias("summary"), F.when(k % 5 != 0, k * 100).cast("int").alias("views"), F.when(k % 2 == 0, k).cast("int").alias("links"))


def place_rows(spark, d):
    """Catalogue rows of all elements that saved map queries hold."""
    return P.build_places(_found(spark, d), _info(spark, d))


def places_refreshed(spark, d):
    """The whole preparation: one element per name, keys near their known place, twenty of each city in turn of kind, numbered."""
    known = D.hubs(spark, d).where("id % 6 <> 0").select(F.concat(F.lit("Q"), "id").alias("key"), F.col("lat").alias("known_lat"), F.col("lon").alias("known_lon"))
    return P.refresh_places(_found(spark, d), _info(spark, d), known, 20).select("poi_id", "ord", "destination_id", "name", "category", "description_source", "popularity_score")


def context_lines(spark, d):
    """Places as lines of context, with the reason that the graph gave, if any."""
    p, k = D.places(spark, d), F.col("id")
    why = _pick(["near a hub", None, "liked"], k)
    return p.select("id", T.context_line(F.col("name"), F.col("category"), F.when(k % 4 != 0, F.concat(F.lit("place "), k)), why).alias("line"))


def dedented_prompts(spark, d):
    """Templates whose lines are all indented, some deeper, about whole benchmark texts (in one line)."""
    text = F.concat(F.lit("\n    Item "), F.col("item_id"), F.lit("\n      "), F.translate("text", "\n\r\t", "   "), F.lit("\n\n    end\n  "))
    return D.table(spark, d, "benchmark").select("item_id", F.md5(T.dedent(text)).alias("digest"))


QUERIES = {f.__name__: f for f in (transport_csv, destinations_csv, survey_csv, demand_refresh, text_lines, edges_by_relation, map_answers, entity_lookup, entity_batches, title_batches, titled_without_info, article_coordinates, monthly_views, article_summaries, request_log, place_rows, places_refreshed, context_lines, dedented_prompts)}

# ------------------------------------------------------------------------ SQL

ELEMENTS = f"""{D.PLACES},
el AS (SELECT id, destination_id, n_name AS city, lat, lon, CASE WHEN id % 13 <> 0 THEN 'Place ' || id % 40 END AS name, CASE WHEN id % 3 <> 0 THEN 'Q' || id % 50 END AS qid,
  {_at([a for a, _ in TAG_SETS], 'id')} AS k, {_at([b for _, b in TAG_SETS], 'id')} AS v, {_at(HOURS, 'id')} AS hours, {_at(['no', 'yes', None, 'donation'], 'id')} AS fee, {_at([None, '5 EUR', ''], 'id')} AS charge
  FROM places JOIN nation ON n_nationkey = destination_id),
kinds AS (SELECT *, {_case('k', 'v')} AS category FROM el WHERE id % 11 <> 0),
info AS (SELECT 'Q' || s_suppkey AS qid, CASE WHEN s_suppkey % 3 <> 0 THEN 'kind ' || s_suppkey END AS known, CASE WHEN s_suppkey % 4 = 0 THEN 'Known since ' || s_suppkey + 1000 || '.' END AS summary,
  CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey * 100)::INT END AS views, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::INT END AS links FROM supplier)"""
FAME = "round(0.6::DOUBLE * ln(1 + coalesce(views, 0)::DOUBLE) + 0.8::DOUBLE * ln(1 + coalesce(links, 0)::DOUBLE), 9)"
_default = lambda i: "CASE category " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in T.CATEGORY_DEFAULTS.items()) + " END"
ENTITY = """ent AS (SELECT 'Q' || q AS qid, CASE WHEN (k + i) % 3 <> 0 THEN 'kind ' || k % 5 END AS description, (k % 60)::INT AS sitelinks, CASE WHEN k % 4 <> 0 THEN 'Title ' || q END AS title
  FROM (SELECT s_suppkey AS k, i, s_suppkey * 2 + i AS q FROM supplier, (SELECT unnest([0, 1]) AS i) WHERE s_suppkey % 7 <> 0))"""

SQL = {
    "transport_csv": f"WITH {D.HUBS} SELECT 'T' || id AS transport_id, 'N' || destination_id AS destination_id, 'Hub \"' || id || '\", north' AS name, {_at(KINDS, 'id')} AS type, lat, lon FROM hubs",
    "destinations_csv": """SELECT 'N' || n_nationkey AS destination_id, n_name AS city, 'R' || n_regionkey AS country, n_nationkey + 0.5::DOUBLE AS lat, n_nationkey + 0.25::DOUBLE AS lon, (n_nationkey % 3 + 1)::INT AS budget_level,
      i::INT AS at, CASE i WHEN 0 THEN lower(n_name) ELSE 't' || n_nationkey % 3 END AS tag FROM nation, (SELECT unnest([0, 1]) AS i)""",
    "survey_csv": "SELECT upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS archetype, count(*) AS n, round(avg(c_custkey % 2 / 2.0::DOUBLE), 6) AS budget, round(avg(c_custkey % 7 / 7.0::DOUBLE), 6) AS adventure FROM customer GROUP BY 1",
    "demand_refresh": f"WITH {D.DEMAND} SELECT key::VARCHAR AS destination_id, month AS date, value AS visitors FROM demand",
    "text_lines": "SELECT md5(line) AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) GROUP BY 1",
    "edges_by_relation": "SELECT s_nationkey AS src, s_suppkey AS dst, 'HAS_TRANSPORT' AS relation FROM supplier",
    "map_answers": f"""WITH {ELEMENTS} SELECT destination_id, CASE WHEN id % 11 = 0 THEN 'timeout' END AS remark, CASE WHEN id % 11 <> 0 THEN CASE WHEN id % 2 = 0 THEN 'node' ELSE 'way' END END AS type,
      CASE WHEN id % 11 <> 0 THEN id END AS id, CASE WHEN id % 11 <> 0 THEN lat END AS y, CASE WHEN id % 11 <> 0 THEN lon END AS x, CASE WHEN id % 11 <> 0 THEN name END AS name, CASE WHEN id % 11 <> 0 THEN qid END AS entity FROM el""",
    "entity_lookup": f"WITH {ENTITY} SELECT * FROM ent",
    "entity_batches": f"WITH {ELEMENTS} SELECT DISTINCT qid, true AS fits FROM el WHERE qid IS NOT NULL",
    "title_batches": f"WITH {ENTITY} SELECT DISTINCT title, true AS fits FROM ent WHERE title IS NOT NULL",
    "titled_without_info": f"WITH {ENTITY} SELECT title FROM ent WHERE title IS NOT NULL EXCEPT SELECT 'Title ' || s_suppkey * 2 FROM supplier WHERE s_suppkey % 3 = 0",
    "article_coordinates": f"WITH {D.HUBS} SELECT CASE WHEN id % 2 = 0 THEN 'Hub_' ELSE 'Hub ' END || id AS title, round(lat, 6) AS lat, round(lon, 6) AS lon FROM hubs WHERE id % 5 <> 0",
    "monthly_views": "SELECT 'User ' || user_id AS title, trunc(avg(n))::INT AS views FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id",
    "article_summaries": r"""SELECT doc_id::VARCHAR AS title, length(s)::BIGINT AS n, md5(s) AS digest FROM (SELECT doc_id, nullif(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')), '') AS s FROM documents)""",
    "request_log": f"""WITH a AS (SELECT user_id || '/' || ts::DATE AS key, event_id AS nth, {_at(STATUS, 'event_id')}::INT AS status, event_id % 7 <> 0 AS readable FROM events),
      g AS (SELECT key, count(*) AS n, coalesce(bool_or(status < 400 AND readable), false) AS ok, coalesce(list(status ORDER BY nth)[-1], 0) AS last FROM a GROUP BY key),
      s AS (SELECT *, CASE WHEN ok THEN 'answered' WHEN last BETWEEN 400 AND 499 AND last <> 429 THEN 'absent' WHEN n >= 4 THEN 'given up' ELSE 'retry' END AS state FROM g)
      SELECT key, state, CASE WHEN state = 'retry' THEN 5.0::DOUBLE * pow(2.0::DOUBLE, n - 1) END AS wait FROM s""",
    "place_rows": f"""WITH {ELEMENTS},
      h AS (SELECT *, try_cast(regexp_extract(hours, '{PATTERN}', 1) AS INT) AS a, try_cast(regexp_extract(hours, '{PATTERN}', 2) AS INT) AS b FROM kinds WHERE category IS NOT NULL AND name IS NOT NULL),
      o AS (SELECT h.*, known, summary, views, links, coalesce(a BETWEEN 0 AND 24 AND b BETWEEN 0 AND 24, false) AS read, coalesce(fee = 'yes' OR coalesce(charge, '') <> '', coalesce(charge, '') <> '') AS paid, {FAME} AS fame FROM h LEFT JOIN info USING (qid)),
      f AS (SELECT *, 2.5::DOUBLE + 2.5::DOUBLE * cume_dist() OVER (PARTITION BY destination_id ORDER BY fame) AS x FROM o)
      SELECT id AS ord, destination_id, name, category, round(lat, 6) AS lat, round(lon, 6) AS lon, {_default(0)} AS avg_visit_minutes, CASE WHEN fee = 'no' THEN 0 WHEN paid THEN greatest({_default(1)}, 1) ELSE {_default(1)} END AS price_level,
      CASE WHEN fee = 'no' OR paid THEN 'osm' ELSE 'category_default' END AS price_source,
      CASE WHEN summary IS NOT NULL THEN summary WHEN known IS NOT NULL THEN name || ' is a ' || known || ', in ' || city || '.' ELSE CASE category {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.TEMPLATES.items())} ELSE '{T.ANY_TEMPLATE}' END || city || '.' END AS description,
      CASE WHEN summary IS NOT NULL THEN 'wikipedia' WHEN known IS NOT NULL THEN 'wikidata' ELSE 'template' END AS description_source,
      CASE WHEN read THEN a ELSE {_default(2)} END AS open_hour, CASE WHEN read THEN b ELSE {_default(3)} END AS close_hour, CASE WHEN read THEN 'osm' ELSE 'category_default' END AS hours_source,
      qid AS wikidata_qid, links AS sitelink_count, views AS monthly_pageviews, {D.half_even('x', 2)} AS popularity_score FROM f""",
    "places_refreshed": f"""WITH {ELEMENTS}, {D.HUBS},
      one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY destination_id, lower(name) ORDER BY (qid IS NOT NULL) DESC, id) AS rn, min(id) OVER (PARTITION BY destination_id, lower(name)) AS position FROM kinds WHERE name IS NOT NULL) WHERE rn = 1),
      bad AS (SELECT DISTINCT one.qid FROM one LEFT JOIN hubs h ON 'Q' || h.id = one.qid AND h.id % 6 <> 0 WHERE one.qid IS NOT NULL AND (h.id IS NULL OR {D.km('one.', 'h.')} > 5.0)),
      good AS (SELECT one.*, known, summary, {FAME} AS fame FROM one LEFT JOIN info USING (qid) WHERE category IS NOT NULL AND (qid IS NULL OR qid NOT IN (SELECT qid FROM bad))),
      t AS (SELECT *, row_number() OVER (PARTITION BY destination_id, category ORDER BY fame DESC, position) AS turn, min(position) OVER (PARTITION BY destination_id, category) AS seen FROM good),
      c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY destination_id ORDER BY turn, seen, position) AS rank FROM t) WHERE rank <= 20),
      f AS (SELECT *, 2.5::DOUBLE + 2.5::DOUBLE * cume_dist() OVER (PARTITION BY destination_id ORDER BY fame) AS x FROM c)
      SELECT 'POI' || lpad((row_number() OVER (ORDER BY destination_id, id))::VARCHAR, 4, '0') AS poi_id, id AS ord, destination_id, name, category,
      CASE WHEN summary IS NOT NULL THEN 'wikipedia' WHEN known IS NOT NULL THEN 'wikidata' ELSE 'template' END AS description_source, {D.half_even('x', 2)} AS popularity_score FROM f""",
    "context_lines": f"WITH {D.PLACES} SELECT id, name || ' (' || category || '): ' || CASE WHEN id % 4 <> 0 THEN 'place ' || id ELSE '' END || CASE id % 3 WHEN 0 THEN ' [graph: near a hub]' WHEN 2 THEN ' [graph: liked]' ELSE '' END AS line FROM places",
    "dedented_prompts": "SELECT item_id, md5('Item ' || item_id || chr(10) || '  ' || translate(text, chr(10) || chr(13) || chr(9), '   ') || chr(10) || chr(10) || 'end') AS digest FROM benchmark",
}
