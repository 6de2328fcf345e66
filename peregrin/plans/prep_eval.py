"""Queries of data preparation and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scoring as S, text as T
from ..operators import evaluate as E, prep as P, retrieval as R
from ..sources import landed as L, tables as TB
from . import demo as D, retrieval_graph as RG

TAG_SETS = [("historic", "castle"), ("amenity", "bar"), ("tourism", "museum"), ("leisure", "park"), ("shop", "mall"), ("natural", "beach"), ("amenity", "bank"), ("historic", "ruins")]
HOURS = ["Mo-Fr 09:00-18:00", "10:30 - 2:15", "24/7", None, "99:00-10:00", "Sa 8:00-12:00; Su 13:00-17:00"]
QIDS = ["Q12; Q13", "x,Q7", " Q5", "none", None, "Q1Q2 Q33"]
LONG = "Built long ago it stands there still. It was burnt twice! Was it mended? It was, and better than before. "


def _pick(items: list, key) -> F.Column:
    return F.element_at(F.array(*(F.lit(x).cast("string") for x in items)), (key % len(items) + 1).cast("int"))


def rule_classify(spark, d):
    k = F.col("p_partkey")
    key, value = _pick([a for a, _ in TAG_SETS], k), _pick([b for _, b in TAG_SETS], k)
    tags = F.map_concat(F.create_map(key, value), F.create_map(F.lit("name"), F.col("p_name")), F.when(k % 5 == 0, F.create_map(F.lit("tourism_x"), F.lit("attraction"))).otherwise(F.create_map(F.lit("zz"), F.lit("y"))))
    return D.table(spark, d, "part").select("p_partkey", T.classify_tags(tags).alias("category"))


def opening_hours_parse(spark, d):
    h = D.table(spark, d, "part").select("p_partkey", T.opening_hours(_pick(HOURS, F.col("p_partkey"))).alias("h"))
    return h.select("p_partkey", "h.open", "h.close")


def qid_normalize(spark, d):
    return D.table(spark, d, "part").select("p_partkey", T.normalize_qid(_pick(QIDS, F.col("p_partkey"))).alias("qid"))


def trim_description(spark, d):
    """Whole benchmark texts on one line; the digest stands for the text."""
    text = F.concat(F.repeat(F.lit(LONG), (F.col("item_id") % 7).cast("int")), F.translate("text", "\n", " "))
    t = T.trim_description(text)
    return D.table(spark, d, "benchmark").select("item_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"))


def describe_template(spark, d):
    k = F.col("c_custkey")
    known = _pick(["old tower", "İstanbul gate", "market of ALGERIA", None, "", "Iron bridge"], k)
    p = D.table(spark, d, "customer").join(F.broadcast(D.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    kinds = F.element_at(F.array(*(F.lit(c) for c in (*T.TEMPLATES, "other"))), (k % 11 + 1).cast("int"))
    return p.select("c_custkey", T.describe(F.col("c_name"), F.col("n_name"), kinds, known).alias("text"))


def fee_price(spark, d):
    k = F.col("p_partkey")
    p = T.price_from_fee(_pick(["no", "yes", None, "donation"], k), _pick([None, "5 EUR", ""], k), (k % 3).cast("int"))
    return D.table(spark, d, "part").select("p_partkey", p.alias("p")).select("p_partkey", "p.level", "p.source")


def category_defaults(spark, d):
    v = lambda i: T.category_default(F.col("category"), i)
    return D.places(spark, d).select("id", v(0).alias("visit"), v(1).alias("price"), v(2).alias("open"), v(3).alias("close"))


def provenance_counts(spark, d):
    return fee_price(spark, d).groupBy("source").agg(F.count("*").alias("n"))


def dedupe_upgrade(spark, d):
    p = D.table(spark, d, "part").select("p_brand", F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 3 == 0).alias("known"))
    return P.dedupe_named(p, ["p_brand"], "name", F.col("known"), "ord").select("p_brand", F.lower(F.trim("name")).alias("name"), "ord", "position", "known")


def diversify_round_robin(spark, d):
    return P.round_robin(D.places(spark, d), "destination_id", "category", "popularity", "id", 15).select("destination_id", "id", "category", "rank")


def fame_percentile(spark, d):
    orders = D.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("links"))
    rows = D.places(spark, d).join(orders, "id", "left").withColumn("views", (F.col("popularity") * 10).cast("long")).withColumn("views", F.when(F.col("views") > 0, F.col("views")))
    return P.fame_popularity(rows, "destination_id", "views", "links").select("id", F.round("fame", 6).alias("fame"), "popularity")


def sitelink_popularity(spark, d):
    return D.table(spark, d, "part").select("p_partkey", S.popularity_of_links((F.col("p_partkey") % 60).cast("int")).alias("popularity"))


def place_gate(spark, d):
    """A customer's key is that of a supplier, whose coordinates are known if its key isn't a multiple of 5."""
    n = F.lit(90)
    rows = D.places(spark, d).select(F.when(F.col("id") % 4 != 0, F.col("id") % n + 1).alias("key"), "id", "lat", "lon")
    known = D.hubs(spark, d).where("id % 5 <> 0").select(F.col("id").alias("key"), F.col("lat").alias("known_lat"), F.col("lon").alias("known_lon"))
    return P.place_gate(rows, known, 20.0).select("id", "key")


def fuzzy_contains(spark, d):
    lines = D.table(spark, d, "part").select(F.col("p_partkey").alias("line_id"), F.col("p_name").alias("line"))
    names = D.table(spark, d, "part").select(F.concat_ws(" ", F.element_at(F.split("p_name", " "), -1), F.lit("")).alias("name")).unionByName(D.table(spark, d, "nation").select(F.col("n_name").alias("name")))
    return P.fuzzy_matches(lines, names)


def _hits(spark, d):
    """Retrieved vectors of two configurations: the nearest 10, and any with the smallest ids."""
    near = R.cosine_topk(D.table(spark, d, "embeddings"), RG.vector_queries(spark, d), top_k=10).select(F.lit("fusion").alias("config"), "query_id", F.col("vec_id").alias("doc_id"))
    return near.unionByName(near.select(F.lit("hybrid").alias("config"), "query_id", (F.col("doc_id") % 50).alias("doc_id")).distinct())


def recall_precision(spark, d):
    e = D.table(spark, d, "embeddings").select("vec_id", "label")
    q = RG.vector_queries(spark, d).select("query_id", "label")
    gold = q.join(e, "label").where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("doc_id"))
    hits = _hits(spark, d)
    marked = hits.join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("category")), "doc_id", "left")
    by = ["config", "query_id"]
    return E.recall(hits, gold, by).join(E.precision(marked, q.select("query_id", F.col("label").alias("category")), by), by).join(E.grounded(hits, e.select(F.col("vec_id").alias("doc_id")), by), by)


def eval_summary(spark, d):
    return E.summarize(recall_precision(spark, d), ["recall", "precision", "grounded"], ["fusion", "hybrid", "standard"])


def stop_distances(spark, d):
    days = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 7 * 1.25).alias("km"), (F.col("s_suppkey") % 4).alias("n_stops"))
    return E.km_per_stop(days, ["key"])


def statistics_answers(spark, d):
    """Answers in JSON-stat form, one per nation, parsed back to a monthly series."""
    k = F.col("n_nationkey")
    body = F.format_string('{"value": {"0": %d, "2": %d}, "dimension": {"time": {"category": {"index": {"2019-01": 0, "2019-02": 1, "2019-03": 2}}}}}', k * 10, k * 10 + 5)
    return L.statistics_series(D.table(spark, d, "nation").select(k.alias("key"), body.alias("body")))


def road_answers(spark, d):
    """Saved distance tables of two stops per nation; every third failed."""
    k = F.col("n_nationkey")
    body = F.when(k % 3 == 0, F.lit('{"code": "TooBig"}')).otherwise(F.format_string('{"code": "Ok", "distances": [[0, %d], [%d, 0]], "durations": [[0, 600], [660, 0]]}', k * 1000, k * 1000 + 500))
    raw = D.table(spark, d, "nation").select(k.alias("trip_id"), F.lit("foot").alias("profile"), body.alias("body"))
    stops = D.table(spark, d, "nation").select(k.alias("trip_id"), F.posexplode(F.array(k * 2, k * 2 + 1)).alias("place", "id"))
    return L.road_matrix(raw, stops)


def decode_tags(spark, d):
    n = D.table(spark, d, "nation").select("n_nationkey", TB.decode_tags(F.format_string('["%s", "t%d"]', F.lower("n_name"), F.col("n_nationkey") % 3)).alias("tags"))
    return n.select("n_nationkey", F.explode("tags").alias("tag"))


QUERIES = {f.__name__: f for f in (rule_classify, opening_hours_parse, qid_normalize, trim_description, describe_template, fee_price, category_defaults, provenance_counts, dedupe_upgrade, diversify_round_robin, fame_percentile, sitelink_popularity, place_gate, fuzzy_contains, recall_precision, eval_summary, stop_distances, statistics_answers, road_answers, decode_tags)}

# ------------------------------------------------------------------------ SQL

_lit = lambda x: "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _at(items: list, key: str) -> str:
    return f"[{', '.join(map(_lit, items))}]::VARCHAR[][({key} % {len(items)} + 1)::INT]".replace("::VARCHAR[][", "[")


def _case(k: str, v: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} = '{a}'" + (f" AND {v} = '{b}'" if b else "") + f" THEN '{c}'" for a, b, c in T.TAG_RULES) + " END"


DEFAULT = lambda i: "CASE category " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in T.CATEGORY_DEFAULTS.items()) + " END"
PATTERN = r"(\d{1,2}):\d{2}\s*-\s*(\d{1,2}):\d{2}"
FEE = f"""p AS (SELECT p_partkey, {_at(["no", "yes", None, "donation"], "p_partkey")} AS fee, {_at([None, "5 EUR", ""], "p_partkey")} AS charge, (p_partkey % 3)::INT AS dflt FROM part),
fees AS (SELECT p_partkey, CASE WHEN fee = 'no' THEN 0 WHEN fee = 'yes' OR coalesce(charge, '') <> '' THEN greatest(dflt, 1) ELSE dflt END::INT AS level, CASE WHEN fee = 'no' OR fee = 'yes' OR coalesce(charge, '') <> '' THEN 'osm' ELSE 'category_default' END AS source FROM p)"""
HITS = f"""{RG.COSINE.format(where='q.vec_id % 100 = 0')},
near AS (SELECT query_id, vec_id AS doc_id FROM semantic WHERE rank <= 10),
hits AS (SELECT 'fusion' AS config, query_id, doc_id FROM near UNION ALL SELECT DISTINCT 'hybrid', query_id, doc_id % 50 FROM near),
gold AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id AND q.vec_id % 100 = 0),
sizes AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
res AS (SELECT config, h.query_id, coalesce(any_value(n_gold), 0) AS n_gold, count(g.doc_id) AS n_hit, round(count(g.doc_id)::DOUBLE / nullif(any_value(n_gold), 0), 6) AS recall,
  round(coalesce(avg(CASE WHEN v.label = q.label THEN 1.0 ELSE 0.0 END), 0.0)::DOUBLE, 3) AS precision, max(CASE WHEN v.vec_id IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE AS grounded
  FROM hits h LEFT JOIN gold g ON g.query_id = h.query_id AND g.doc_id = h.doc_id LEFT JOIN sizes s ON s.query_id = h.query_id JOIN embeddings q ON q.vec_id = h.query_id LEFT JOIN embeddings v ON v.vec_id = h.doc_id GROUP BY 1, 2)"""
KNOWN = _at(["old tower", "İstanbul gate", "market of ALGERIA", None, "", "Iron bridge"], "c_custkey")

SQL = {
    "rule_classify": f"SELECT p_partkey, {_case('k', 'v')} AS category FROM (SELECT p_partkey, {_at([a for a, _ in TAG_SETS], 'p_partkey')} AS k, {_at([b for _, b in TAG_SETS], 'p_partkey')} AS v FROM part)",
    "opening_hours_parse": f"""WITH h AS (SELECT p_partkey, {_at(HOURS, 'p_partkey')} AS r FROM part), x AS (SELECT p_partkey, try_cast(regexp_extract(r, '{PATTERN}', 1) AS INT) AS a, try_cast(regexp_extract(r, '{PATTERN}', 2) AS INT) AS b FROM h)
      SELECT p_partkey, CASE WHEN a BETWEEN 0 AND 24 AND b BETWEEN 0 AND 24 THEN a END AS open, CASE WHEN a BETWEEN 0 AND 24 AND b BETWEEN 0 AND 24 THEN b END AS close FROM x""",
    "qid_normalize": f"SELECT p_partkey, list_filter(string_split_regex({_at(QIDS, 'p_partkey')}, '[;,\\s]+'), lambda x: regexp_full_match(x, 'Q[0-9]+'))[1] AS qid FROM part",
    "trim_description": f"""WITH t AS (SELECT item_id, repeat({_lit(LONG)}, (item_id % 7)::INT) || translate(text, chr(10), ' ') AS t FROM benchmark),
      s AS (SELECT item_id, t, string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)) AS s FROM t),
      p AS (SELECT item_id, t, i, array_to_string(s[1:i], ' ') AS p FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM s)),
      k AS (SELECT item_id, t, trim(arg_max(p, i)) AS kept FROM p WHERE i = 1 OR length(p) <= {T.DESCRIPTION_CHARS} GROUP BY 1, 2),
      r AS (SELECT item_id, CASE WHEN length(t) <= {T.DESCRIPTION_CHARS} THEN t ELSE kept END AS r FROM k)
      SELECT item_id, length(r)::BIGINT AS n, md5(r) AS digest FROM r""",
    "describe_template": f"""WITH c AS (SELECT c_custkey, c_name, n_name, {KNOWN} AS k, {_at([*T.TEMPLATES, 'other'], 'c_custkey')} AS cat FROM customer JOIN nation ON c_nationkey = n_nationkey)
      SELECT c_custkey, CASE WHEN coalesce(k, '') <> '' THEN c_name || ' is ' || CASE WHEN lower(k[1]) IN ('a', 'e', 'i', 'o', 'u') AND k[1] <> 'İ' THEN 'an' ELSE 'a' END || ' ' || k || CASE WHEN contains(lower(replace(k, 'İ', 'I')), lower(n_name)) THEN '.' ELSE ', in ' || n_name || '.' END
      ELSE CASE cat {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in T.TEMPLATES.items())} ELSE '{T.ANY_TEMPLATE}' END || n_name || '.' END AS text FROM c""",
    "fee_price": f"WITH {FEE} SELECT * FROM fees",
    "provenance_counts": f"WITH {FEE} SELECT source, count(*) AS n FROM fees GROUP BY 1",
    "category_defaults": f"WITH {D.PLACES} SELECT id, {DEFAULT(0)} AS visit, {DEFAULT(1)} AS price, {DEFAULT(2)} AS open, {DEFAULT(3)} AS close FROM places",
    "dedupe_upgrade": """WITH p AS (SELECT p_brand, lower(trim(p_name)) AS name, p_partkey AS ord, p_partkey % 3 = 0 AS known FROM part),
      r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, name ORDER BY known DESC, ord) AS rn, min(ord) OVER (PARTITION BY p_brand, name) AS position FROM p) SELECT p_brand, name, ord, position, known FROM r WHERE rn = 1""",
    "diversify_round_robin": f"""WITH {D.PLACES}, t AS (SELECT *, row_number() OVER (PARTITION BY destination_id, category ORDER BY popularity DESC, id) AS turn, min(id) OVER (PARTITION BY destination_id, category) AS seen FROM places)
      SELECT destination_id, id, category, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY destination_id ORDER BY turn, seen, id) AS rank FROM t) WHERE rank <= 15""",
    "fame_percentile": f"""WITH {D.PLACES}, o AS (SELECT o_custkey AS id, count(*) AS links FROM orders GROUP BY 1),
      f AS (SELECT p.id, destination_id, round(0.6::DOUBLE * ln(1 + greatest(trunc(popularity * 10), 0)::DOUBLE) + 0.8::DOUBLE * ln(1 + coalesce(links, 0)::DOUBLE), 9) AS fame FROM places p LEFT JOIN o USING (id))
      SELECT id, round(fame, 6) AS fame, {D.half_even('x', 2)} AS popularity FROM (SELECT *, 2.5::DOUBLE + 2.5::DOUBLE * cume_dist() OVER (PARTITION BY destination_id ORDER BY fame) AS x FROM f)""",
    "sitelink_popularity": f"SELECT p_partkey, CASE WHEN p_partkey % 60 > 0 THEN {D.half_even('x', 1)} ELSE 4.0 END::DOUBLE AS popularity FROM (SELECT p_partkey, least(4.9::DOUBLE, 3.9::DOUBLE + 0.15::DOUBLE * ln(1 + (p_partkey % 60)::DOUBLE)) AS x FROM part)",
    "place_gate": f"""WITH {D.PLACES}, {D.HUBS}, r AS (SELECT CASE WHEN id % 4 <> 0 THEN id % 90 + 1 END AS key, id, lat, lon FROM places),
      bad AS (SELECT DISTINCT r.key FROM r LEFT JOIN hubs h ON h.id = r.key AND h.id % 5 <> 0 WHERE r.key IS NOT NULL AND (h.id IS NULL OR {D.km('r.', 'h.')} > 20.0))
      SELECT id, key FROM r WHERE key IS NULL OR key NOT IN (SELECT key FROM bad)""",
    "fuzzy_contains": """WITH names AS (SELECT DISTINCT lower(trim(n)) AS n FROM (SELECT string_split(p_name, ' ')[-1] AS n FROM part UNION ALL SELECT n_name FROM nation) WHERE trim(n) <> '')
      SELECT p_partkey AS line_id, p_name AS line, EXISTS (SELECT 1 FROM names WHERE contains(lower(trim(p_name)), n) OR contains(n, lower(trim(p_name)))) AS matched FROM part""",
    "recall_precision": f"WITH {HITS} SELECT * FROM res",
    "eval_summary": f"WITH {HITS} SELECT config, round(avg(recall), 3) AS recall, round(avg(precision), 3) AS precision, round(avg(grounded), 3) AS grounded, CASE config WHEN 'fusion' THEN 0 WHEN 'hybrid' THEN 1 ELSE 2 END AS ord FROM res GROUP BY config",
    "stop_distances": "SELECT s_suppkey AS key, nullif(round(s_suppkey % 7 * 1.25::DOUBLE / nullif(s_suppkey % 4, 0), 3), 0) AS km_per_stop FROM supplier",
    "statistics_answers": "SELECT n_nationkey AS key, DATE '2019-01-01' AS month, (n_nationkey * 10)::BIGINT AS value FROM nation UNION ALL SELECT n_nationkey, DATE '2019-03-01', (n_nationkey * 10 + 5)::BIGINT FROM nation",
    "road_answers": "SELECT n_nationkey AS trip_id, n_nationkey * 2 AS src, n_nationkey * 2 + 1 AS dst, 'foot' AS profile, n_nationkey::DOUBLE AS km, 10.0::DOUBLE AS minutes FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT n_nationkey, n_nationkey * 2 + 1, n_nationkey * 2, 'foot', n_nationkey + 0.5::DOUBLE, 11.0::DOUBLE FROM nation WHERE n_nationkey % 3 <> 0",
    "decode_tags": "SELECT n_nationkey, unnest([lower(n_name), 't' || n_nationkey % 3]) AS tag FROM nation",
}
