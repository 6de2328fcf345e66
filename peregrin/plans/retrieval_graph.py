"""Queries of retrieval and of the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import graph as G, retrieval as R
from ..session import small_table
from . import demo as D

#: (id, query, language wanted or none)
QUERIES_TEXT = [(1, "the onanst hentha and the thing", None), (2, "de la que ciones", "es"), (3, "der die und einver", "de"), (4, "museum near station", None)]
#: (id, query, city wanted or none) of places; the vector of query q is that of vec_id q.
PLACE_QUERIES = [(1, "a museum in France", 6), (2, "food and nightlife", None), (3, "landmark or history in Germany", 7), (4, "nature near China", None)]
GRAPH_QUERIES = [(1, 3, None, "culture museum walk"), (2, 7, None, "best food close to the airport"), (3, 11, "Nature & Adventure", "anything"), (4, 2, None, "quiet streets"), (5, None, None, "museum"), (6, 9, "Unknown", "shopping")]
K = 10


def text_queries(spark: SparkSession) -> DataFrame:
    return small_table(spark, QUERIES_TEXT, "query_id long, query string, lang string")


def tokenize_stats(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("w"))
    return docs.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def corpus_union(spark, d):
    docs = D.table(spark, d, "documents").select(F.concat(F.lit("doc::"), F.col("doc_id").cast("string")).alias("doc_id"), F.lit("doc").alias("type"), F.col("lang").alias("city"), F.length("text").cast("long").alias("n"))
    items = D.table(spark, d, "benchmark").select(F.concat(F.lit("item::"), F.col("item_id").cast("string")).alias("doc_id"), F.lit("item").alias("type"), F.length("text").cast("long").alias("n"))
    return docs.unionByName(items, allowMissingColumns=True)


def place_documents(spark, d):
    p = D.places(spark, d).join(F.broadcast(D.cities(spark, d)), "destination_id")
    return p.select(F.concat(F.lit("poi::"), F.col("id").cast("string")).alias("doc_id"), T.document_text(F.col("name"), F.col("category"), F.col("city"), F.lit(None).cast("string")).alias("text"))


def bm25_idf(spark, d):
    return R.idf_table(D.table(spark, d, "documents"), "doc_id", "text").select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d):
    return R.bm25(D.table(spark, d, "documents"), text_queries(spark), filter_col="lang", top_k=K).withColumn("score", F.round("score", 4))


def vector_queries(spark, d):
    return D.table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


def cosine_topk(spark, d):
    return R.cosine_topk(D.table(spark, d, "embeddings"), vector_queries(spark, d), top_k=K)


def cosine_topk_by_label(spark, d):
    return R.cosine_topk(D.table(spark, d, "embeddings"), vector_queries(spark, d), filter_col="label", top_k=K)


def _lists(spark, d):
    """Vector, keyword and graph lists of the queries about places: all three name places by one id."""
    q = small_table(spark, PLACE_QUERIES, "query_id long, query string, destination_id int")
    vectors = D.query_vectors(spark, d).where(F.col("vec_id").isin([i for i, _, _ in PLACE_QUERIES])).withColumnRenamed("vec_id", "query_id")
    found = R.document_search(q.join(vectors, "query_id", "left"), D.place_texts(spark, d), D.place_vectors(spark, d), 2 * K)
    routed = q.withColumn("r", T.route_query(F.col("query"), F.lit(None).cast("string"))).select("query_id", "destination_id", "r.*")
    graph = G.graph_search(routed, D.places(spark, d), D.hubs(spark, d), G.affinity_table(spark), 2 * K).select("query_id", F.lit("graph").alias("retriever"), "doc_id", "rank")
    return found.unionByName(graph)


def rrf_fusion(spark, d):
    return R.reciprocal_rank_fusion(_lists(spark, d), K, "fusion").drop("payload", "sources")


def rrf_hybrid(spark, d):
    return R.reciprocal_rank_fusion(_lists(spark, d), K, "hybrid").drop("payload", "sources")


def rrf_provenance(spark, d):
    lists = _lists(spark, d).withColumn("payload", F.concat_ws("#", "retriever", F.col("doc_id").cast("string")))
    return R.reciprocal_rank_fusion(lists, K, "fusion").select("query_id", "doc_id", "sources", "payload")


def fused_narrative(spark, d):
    lists = _lists(spark, d).withColumn("payload", F.concat_ws("#", "retriever", F.col("doc_id").cast("string")))
    return R.narrate(R.reciprocal_rank_fusion(lists, K, "fusion"))


def document_queries(spark, d):
    return D.table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def bm25_topk_corpus(spark, d):
    """Whole texts of every hundredth document as queries, against all documents."""
    return R.bm25_many(D.table(spark, d, "documents"), document_queries(spark, d), top_k=K).withColumn("score", F.round("score", 4))


def _corpus_lists(spark, d):
    """Keyword, vector and graph lists for every id divisible by 100; the city of query q is q / 100 modulo 25."""
    vectors, documents = vector_queries(spark, d), document_queries(spark, d)
    semantic = R.cosine_topk(D.table(spark, d, "embeddings"), vectors, top_k=2 * K).select("query_id", F.lit("semantic").alias("retriever"), F.col("vec_id").alias("doc_id"), "rank")
    keyword = R.bm25_many(D.table(spark, d, "documents"), documents, top_k=2 * K).select("query_id", F.lit("keyword").alias("retriever"), "doc_id", "rank")
    popular = R.top(D.places(spark, d).select("destination_id", F.col("id").alias("doc_id"), "popularity"), ["destination_id"], [F.desc("popularity"), F.asc("doc_id")], 2 * K)
    asked = vectors.select("query_id").unionByName(documents.select("query_id")).distinct()
    graph = asked.join(F.broadcast(popular), (F.col("query_id") / 100).cast("long") % 25 == F.col("destination_id")).select("query_id", F.lit("graph").alias("retriever"), "doc_id", "rank")
    return semantic.unionByName(keyword).unionByName(graph).withColumn("payload", F.concat_ws("#", "retriever", F.col("doc_id").cast("string")))


def rrf_fusion_corpus(spark, d):
    return R.reciprocal_rank_fusion(_corpus_lists(spark, d), K, "fusion").drop("payload", "sources")


def rrf_hybrid_corpus(spark, d):
    return R.reciprocal_rank_fusion(_corpus_lists(spark, d), K, "hybrid").drop("payload", "sources")


def rrf_provenance_corpus(spark, d):
    return R.reciprocal_rank_fusion(_corpus_lists(spark, d), K, "fusion").select("query_id", "doc_id", "sources", "payload")


def fused_narrative_corpus(spark, d):
    return R.narrate(R.reciprocal_rank_fusion(_corpus_lists(spark, d), K, "fusion"))


def keyword_router(spark, d):
    c = D.table(spark, d, "conversations").select("conv_id", "turn", T.route_query(F.col("text"), F.lit(None).cast("string")).alias("r"))
    return c.select("conv_id", "turn", "r.*")


def keyword_router_documents(spark, d):
    c = D.table(spark, d, "documents").select("doc_id", T.route_query(F.col("text"), F.lit(None).cast("string")).alias("r"))
    return c.select("doc_id", "r.*")


def graph_has_poi(spark, d):
    return G.contains_edges(D.cities(spark, d), D.places(spark, d), "HAS_POI").unionByName(G.contains_edges(D.cities(spark, d), D.hubs(spark, d), "HAS_TRANSPORT"))


def graph_node_stats(spark, d):
    return G.node_counts(City=D.cities(spark, d), POI=D.places(spark, d), Transport=D.hubs(spark, d), ArchetypeProfile=G.affinity_table(spark).select("archetype").distinct())


def graph_edge_stats(spark, d):
    places, cities = D.places(spark, d), D.cities(spark, d)
    prefers = places.join(F.broadcast(G.affinity_table(spark)), "category")
    counts = G.edge_counts(HAS_POI=G.contains_edges(cities, places, "HAS_POI"), HAS_TRANSPORT=G.contains_edges(cities, D.hubs(spark, d), "HAS_TRANSPORT"), PREFERS=prefers)
    # Near places are counted by the points where they lie, and places of a class, which are all linked, by class: neither is listed.
    return counts.unionByName(G.near_count(places)).unionByName(G.same_category_classes(places).agg(F.lit("SAME_CATEGORY").alias("relation"), F.coalesce(F.sum("links"), F.lit(0)).alias("n")))


def graph_near_edges(spark, d):
    return G.near_edges(D.places(spark, d)).select("src", "dst", F.col("distance_km"))


def nearby_topk(spark, d):
    return G.nearby(D.places(spark, d), 1.5, 5)


def graph_same_category(spark, d):
    return G.same_category_edges(D.hubs(spark, d))


def graph_prefers(spark, d):
    p = D.places(spark, d).join(F.broadcast(G.affinity_table(spark)), "category")
    return p.groupBy("archetype", "category").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


def archetype_preferred(spark, d):
    return G.preferred_places(D.places(spark, d), G.affinity_table(spark), 5).select("archetype", "destination_id", "id", "weight", "popularity", "rank")


def nearest_hub(spark, d):
    return G.nearest_hub(D.places(spark, d), D.hubs(spark, d), 3.0)


def graph_search_routed(spark, d):
    q = small_table(spark, GRAPH_QUERIES, "query_id long, destination_id int, given string, query string")
    q = q.withColumn("r", T.route_query(F.col("query"), F.col("given"))).select("query_id", "destination_id", "r.*")
    return G.graph_search(q, D.places(spark, d), D.hubs(spark, d), G.affinity_table(spark), 20)


QUERIES = {f.__name__: f for f in (tokenize_stats, corpus_union, place_documents, bm25_idf, bm25_topk, cosine_topk, cosine_topk_by_label, rrf_fusion, rrf_hybrid, rrf_provenance, fused_narrative, bm25_topk_corpus, rrf_fusion_corpus, rrf_hybrid_corpus, rrf_provenance_corpus, fused_narrative_corpus, keyword_router, keyword_router_documents, graph_has_poi, graph_node_stats, graph_edge_stats, graph_near_edges, nearby_topk, graph_same_category, graph_prefers, archetype_preferred, nearest_hub, graph_search_routed)}

# ------------------------------------------------------------------------ SQL

_values = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
AFFINITY = "affinity(archetype, category, weight, ord) AS (VALUES " + _values([(a, c, w, i) for i, (a, c, w) in enumerate((a, c, w) for a, cs in G.AFFINITY.items() for c, w in cs.items())]) + ")"
BM25 = f"""toks AS (SELECT doc_id AS doc, lang, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z'']+') AS w FROM documents),
post AS (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY doc, term),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean_dl FROM toks),
raw AS (SELECT term, count(*) AS df, ln(n - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM post, n GROUP BY term, n),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
BM25_LIST = f"""{BM25},
q(query_id, query, lang) AS (VALUES {_values(QUERIES_TEXT)}),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-zA-Z'']+')) AS term FROM q) GROUP BY 1, 2),
scored AS (SELECT query_id, doc, round(sum(times * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_dl))), 6) AS score, sum(times * idf * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_dl))) AS s
  FROM post JOIN qt USING (term) JOIN idf USING (term), n GROUP BY 1, 2),
keyword AS (SELECT query_id, doc AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank
  FROM scored JOIN q USING (query_id) JOIN toks USING (doc) WHERE s > 0 AND (q.lang IS NULL OR q.lang = toks.lang))"""
COSINE = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings v WHERE {where}),
semantic AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)"""
ROUTE = lambda q: (
    "CASE " + " ".join("WHEN " + " OR ".join(f"contains({q}, '{w}')" for w in ws) + f" THEN '{a}'" for a, ws in T.ARCHETYPE_WORDS.items()) + " END AS archetype, "
    + "CASE " + " ".join(f"WHEN contains({q}, '{c}') THEN '{c}'" for c in T.CATEGORY_WORDS) + " END AS category, "
    + "(" + " OR ".join(f"contains({q}, '{w}')" for w in T.TRANSPORT_WORDS) + ") AS near_transport"
)
LIKED = """liked AS (SELECT archetype, destination_id, id, weight, popularity, row_number() OVER (PARTITION BY archetype, destination_id ORDER BY weight DESC, popularity DESC, ord, id) AS rank
  FROM places JOIN affinity USING (category))"""
NEAR = f"near AS (SELECT a_ AS src, b_ AS dst, {D.half_even('km', 3)} AS distance_km FROM (SELECT a.id AS a_, b.id AS b_, {D.km('a.', 'b.')} AS km FROM places a JOIN places b ON a.destination_id = b.destination_id AND a.id <> b.id) WHERE km <= 2.0)"
HUB = f"hub AS (SELECT p.id, p.destination_id, p.category, min({D.km('p.', 'h.')}) AS km FROM places p JOIN hubs h ON p.destination_id = h.destination_id GROUP BY 1, 2, 3)"

PLACE_TEXTS = "documents AS (SELECT p.id AS doc_id, p.destination_id AS lang, p.name || ' (' || category || ') in ' || n_name || ': ' AS text FROM places p JOIN nation ON n_nationkey = p.destination_id)"
RRF = f"""WITH {D.PLACES}, {D.HUBS}, {AFFINITY}, {PLACE_TEXTS}, {BM25_LIST.replace(_values(QUERIES_TEXT), _values(PLACE_QUERIES))}, {LIKED}, {HUB},
semantic AS (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN q w ON w.query_id = q.vec_id JOIN embeddings v ON true JOIN places p ON p.id = v.vec_id WHERE w.lang IS NULL OR w.lang = p.destination_id),
routed AS (SELECT query_id, lang AS destination_id, {ROUTE('query')} FROM (SELECT query_id, lang, lower(query) AS query FROM q) WHERE lang IS NOT NULL),
found AS (SELECT query_id, id, 0 AS branch, rank AS ord FROM routed q JOIN liked l ON q.destination_id = l.destination_id AND q.archetype = l.archetype AND l.rank <= 20
  UNION ALL SELECT query_id, id, 1, row_number() OVER (PARTITION BY query_id ORDER BY hub_km, id) FROM (SELECT query_id, h.id, {D.half_even('km', 2)} AS hub_km FROM routed q JOIN hub h ON q.destination_id = h.destination_id AND q.category = h.category AND near_transport AND km <= 3.0)
  UNION ALL SELECT query_id, p.id, 1, row_number() OVER (PARTITION BY query_id ORDER BY p.id) FROM routed q JOIN places p ON q.destination_id = p.destination_id AND q.category = p.category AND NOT near_transport),
every AS (SELECT * FROM found UNION ALL SELECT * FROM (SELECT query_id, p.id, 2, row_number() OVER (PARTITION BY query_id ORDER BY popularity DESC, p.id) AS ord FROM routed q JOIN places p ON q.destination_id = p.destination_id WHERE query_id NOT IN (SELECT query_id FROM found)) WHERE ord <= 20),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY branch, ord) AS r FROM every) WHERE r = 1),
graph AS (SELECT query_id, id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY branch, ord, id) AS rank FROM firsts),
lists AS (SELECT query_id::BIGINT AS query_id, 'semantic' AS retriever, vec_id AS doc_id, rank, 0 AS lo FROM semantic WHERE rank <= 20
  UNION ALL SELECT query_id, 'keyword', doc_id, rank, 1 FROM keyword WHERE rank <= 20 UNION ALL SELECT query_id, 'graph', doc_id, rank, 2 FROM graph WHERE rank <= 20),
fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(retriever, ',' ORDER BY retriever) AS sources, max_by(retriever || '#' || doc_id, lo) AS payload, min(lo * 1000 + rank) AS met
  FROM lists WHERE lo <= {{lo}} GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, met, doc_id) AS rank FROM fused)
"""

SQL = {
    "tokenize_stats": "SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-zA-Z'']+') AS w FROM documents)",
    "corpus_union": "SELECT 'doc::' || doc_id AS doc_id, 'doc' AS type, lang AS city, length(text)::BIGINT AS n FROM documents UNION ALL SELECT 'item::' || item_id, 'item', NULL, length(text)::BIGINT FROM benchmark",
    "place_documents": f"WITH {D.PLACES} SELECT 'poi::' || id AS doc_id, name || ' (' || category || ') in ' || n_name || ': ' AS text FROM places JOIN nation ON destination_id = n_nationkey",
    "bm25_idf": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {BM25_LIST} SELECT query_id::BIGINT AS query_id, doc_id, round(score, 4) AS score, rank::INT AS rank FROM keyword WHERE rank <= {K}",
    "cosine_topk": f"WITH {COSINE.format(where='q.vec_id % 100 = 0')} SELECT query_id, vec_id, score, rank::INT AS rank FROM semantic WHERE rank <= {K}",
    "cosine_topk_by_label": f"WITH {COSINE.format(where='q.vec_id % 100 = 0 AND q.label = v.label')} SELECT query_id, vec_id, score, rank::INT AS rank FROM semantic WHERE rank <= {K}",
    "rrf_fusion": RRF.format(lo=2) + f"SELECT query_id, doc_id, score, rank::INT AS rank FROM ranked WHERE rank <= {K}",
    "rrf_hybrid": RRF.format(lo=1) + f"SELECT query_id, doc_id, score, rank::INT AS rank FROM ranked WHERE rank <= {K}",
    "rrf_provenance": RRF.format(lo=2) + f"SELECT query_id, doc_id, sources, payload FROM ranked WHERE rank <= {K}",
    "fused_narrative": RRF.format(lo=2) + "SELECT query_id, string_agg('- ' || payload, chr(10) ORDER BY rank) AS narrative FROM ranked WHERE rank <= 6 GROUP BY query_id",
    "keyword_router": f"SELECT conv_id, turn, {ROUTE('q')} FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations)",
    "keyword_router_documents": f"SELECT doc_id, {ROUTE('q')} FROM (SELECT doc_id, lower(coalesce(text, '')) AS q FROM documents)",
    "graph_has_poi": f"WITH {D.PLACES}, {D.HUBS} SELECT destination_id AS src, id AS dst, 'HAS_POI' AS relation FROM places JOIN nation ON destination_id = n_nationkey UNION ALL SELECT destination_id, id, 'HAS_TRANSPORT' FROM hubs JOIN nation ON destination_id = n_nationkey",
    "graph_node_stats": "SELECT 'City' AS type, count(*) AS n FROM nation UNION ALL SELECT 'POI', count(*) FROM customer UNION ALL SELECT 'Transport', count(*) FROM supplier UNION ALL SELECT 'ArchetypeProfile', 7",
    "graph_edge_stats": f"""WITH {D.PLACES}, {AFFINITY}, {NEAR} SELECT 'HAS_POI' AS relation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'HAS_TRANSPORT', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey
      UNION ALL SELECT 'NEAR', count(*) FROM near UNION ALL SELECT 'PREFERS', count(*) FROM places JOIN affinity USING (category)
      UNION ALL SELECT 'SAME_CATEGORY', coalesce(sum(n * (n - 1)), 0)::BIGINT FROM (SELECT count(*) AS n FROM places GROUP BY destination_id, category)""",
    "graph_near_edges": f"WITH {D.PLACES}, {NEAR} SELECT * FROM near",
    "nearby_topk": f"WITH {D.PLACES}, {NEAR} SELECT src, dst, distance_km, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance_km, dst) AS rank FROM near WHERE distance_km <= 1.5) WHERE rank <= 5",
    "graph_same_category": f"WITH {D.HUBS} SELECT a.id AS src, b.id AS dst, a.category FROM hubs a JOIN hubs b ON a.destination_id = b.destination_id AND a.category = b.category AND a.id <> b.id",
    "graph_prefers": f"WITH {D.PLACES}, {AFFINITY} SELECT archetype, category, count(*) AS n, max(weight)::DOUBLE AS weight FROM places JOIN affinity USING (category) GROUP BY 1, 2",
    "archetype_preferred": f"WITH {D.PLACES}, {AFFINITY}, {LIKED} SELECT archetype, destination_id, id, weight::DOUBLE AS weight, popularity, rank::INT AS rank FROM liked WHERE rank <= 5",
    "nearest_hub": f"WITH {D.PLACES}, {D.HUBS}, {HUB} SELECT id, destination_id, category, {D.half_even('km', 2)} AS nearest_hub_km FROM hub WHERE km <= 3.0",
    "graph_search_routed": f"""WITH {D.PLACES}, {D.HUBS}, {AFFINITY}, {LIKED}, {HUB},
q0(query_id, destination_id, given, query) AS (VALUES {_values(GRAPH_QUERIES)}),
q AS (SELECT query_id, destination_id, coalesce(given, archetype) AS archetype, category, near_transport FROM (SELECT *, {ROUTE('query')} FROM q0) WHERE destination_id IS NOT NULL),
found AS (SELECT query_id, id, 0 AS branch, rank AS ord, 'preferred by ' || l.archetype || ' travelers' AS reason FROM q JOIN liked l ON q.destination_id = l.destination_id AND q.archetype = l.archetype AND l.rank <= 20
  UNION ALL SELECT query_id, id, 1, row_number() OVER (PARTITION BY query_id ORDER BY hub_km, id), hub_km || 'km from nearest transport hub' FROM (SELECT query_id, h.id, {D.half_even('km', 2)} AS hub_km FROM q JOIN hub h ON q.destination_id = h.destination_id AND q.category = h.category AND near_transport AND km <= 3.0)
  UNION ALL SELECT query_id, p.id, 1, row_number() OVER (PARTITION BY query_id ORDER BY p.id), 'category match: ' || q.category FROM q JOIN places p ON q.destination_id = p.destination_id AND q.category = p.category AND NOT near_transport),
every AS (SELECT * FROM found UNION ALL SELECT * FROM (SELECT query_id, p.id, 2, row_number() OVER (PARTITION BY query_id ORDER BY popularity DESC, p.id) AS ord, 'top-rated in city' FROM q JOIN places p ON q.destination_id = p.destination_id WHERE query_id NOT IN (SELECT query_id FROM found)) WHERE ord <= 20),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY branch, ord) AS r FROM every) WHERE r = 1),
ranked AS (SELECT query_id, id, branch, reason, row_number() OVER (PARTITION BY query_id ORDER BY branch, ord, id) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM firsts)
SELECT query_id::BIGINT AS query_id, id AS doc_id, branch, reason, rank::INT AS rank, round(1.0::DOUBLE - (rank - 1)::DOUBLE / n, 6) AS score FROM ranked WHERE rank <= 20""",
}
