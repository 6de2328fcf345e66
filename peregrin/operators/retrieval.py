"""Keyword, vector and fused retrieval for batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import tokenize
from ..session import cut, spread

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
#: Queries that an executor holds at a time.
QUERY_BLOCK = 4096
#: Of whole texts as queries, and the pairs of query and document that a task scores at a time.
TEXT_BLOCK, PAIRS = 8192, 1 << 20
#: A word is scored as a column of a matrix where so large a part of all pairs have it, for so many words at most.
DENSE, DENSE_WORDS = 1 / 200, 2048
LIST_ORDER = {"semantic": 0, "keyword": 1, "graph": 2}
CONFIGS = {"fusion": ("semantic", "keyword", "graph"), "hybrid": ("semantic", "keyword"), "standard": ()}


def vocabulary(docs: DataFrame, text_col: str) -> DataFrame:
    """term, df, total: document frequencies, in one pass over the texts; the row of the null term has the number of documents and of words."""
    words = spread(docs.select(text_col)).select(tokenize(F.col(text_col)).alias("words"))
    rows = words.select(F.size("words").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("words"))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total"))


def corpus_statistics(docs: DataFrame, text_col: str) -> tuple[DataFrame, float]:
    """term, df, idf over the whole corpus, and the mean number of words; a negative idf becomes a quarter of the mean idf of all terms."""
    counts = cut(vocabulary(docs, text_col))
    whole = counts.where("term is null").first()
    n, mean_dl = (whole["df"], whole["total"] / whole["df"]) if whole else (0, 0.0)
    raw = counts.where("term is not null").select("term", "df", (F.log(F.lit(n) - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0]
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.lit(mean)).otherwise(F.col("raw")).alias("idf")), mean_dl


def idf_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, df, idf over the whole corpus."""
    return corpus_statistics(docs, text_col)[0]


def bm25(docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", filter_col: str | None = None, top_k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank of the best documents with a positive score.

    queries: query_id, query and, with filter_col, its wanted value (null: any),
    which is applied after scoring, so that the statistics stay those of the
    whole corpus. A query's repeated words count again. Ties go by doc_id. Only
    the queries' words are counted by document, so only they are shuffled.
    """
    terms = cut(queries.select("query_id", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
    asked = terms.select("term").distinct()
    idf, mean_dl = corpus_statistics(docs, text_col)
    words = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc"), tokenize(F.col(text_col)).alias("words"))
    rows = words.select("doc", F.size("words").cast("long").alias("dl"), F.explode("words").alias("term"))
    hits = rows.join(asked, "term", "left_semi").groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    hits = hits.join(terms, "term").join(idf.join(asked, "term", "left_semi").select("term", "idf"), "term")
    norm = F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(mean_dl or 1.0))
    scores = hits.groupBy("query_id", "doc").agg(F.sum(F.col("times") * F.col("idf") * (F.col("tf") * F.lit(K1 + 1)) / norm).alias("score"))
    scores = scores.where(F.col("score") > 0)
    if filter_col:
        wanted = queries.select("query_id", F.col(filter_col).alias("wanted"))
        have = docs.select(F.col(id_col).alias("doc"), F.col(filter_col).alias("have"))
        scores = scores.join(wanted, "query_id").join(have, "doc").where(F.col("wanted").isNull() | (F.col("wanted") == F.col("have")))
    scores = scores.select("query_id", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))
    return top(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], top_k)


class Best:
    """The k best documents of each query among those offered so far, by score rounded to six places and then id."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.q, self.d, self.s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def offer(self, scores: np.ndarray, keys: np.ndarray) -> None:
        """scores: a row per document, a column per query; -inf is no offer. Only what may come in is rounded and sorted."""
        row, q = np.nonzero(scores >= np.maximum(self.least - 1e-6, np.finfo(float).min))
        if not len(q):
            return
        q, d, s = np.concatenate([self.q, q]), np.concatenate([self.d, keys[row]]), np.concatenate([self.s, np.round(scores[row, q], 6)])
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        kept = rank < self.k
        self.q, self.d, self.s = q[kept], d[kept], s[kept]
        full = rank == self.k - 1
        self.least[q[full]] = s[full]


def _weighted(part: list) -> tuple:
    """Queries (query_id, terms, w, share) as arrays: ids, words, matrix, start, query, weight.

    The first words are the matrix's rows, which have a column per query; the
    queries and weights of word t lie from start[t] on.
    """
    size = [len(r["terms"]) for r in part]
    words, term = np.unique(np.array([t for r in part for t in r["terms"]], object), return_inverse=True) if sum(size) else (np.empty(0, object), np.empty(0, np.int64))
    q, w, share = np.repeat(np.arange(len(part)), size), np.array([x for r in part for x in r["w"]], float), np.array([x for r in part for x in r["share"]], float)
    of_all = np.zeros(len(words))
    of_all[term] = share
    weight = of_all * np.bincount(term, minlength=len(words)) / max(len(part), 1)
    first = np.argsort(-weight, kind="stable")
    n = min(int((weight >= DENSE).sum()), DENSE_WORDS)
    place = np.empty(len(words), np.int64)
    place[first] = np.arange(len(words))
    term = place[term]
    matrix = np.zeros((n, len(part)))
    dense = term < n
    matrix[term[dense], q[dense]] = w[dense]
    order = np.argsort(term, kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(words)))])
    return np.array([r["query_id"] for r in part], np.int64), pa.array(words[first].tolist(), pa.string()), matrix, start, q[order].astype(np.int32), w[order]


def _scores(doc: np.ndarray, term: np.ndarray, share: np.ndarray, n: int, matrix: np.ndarray, start: np.ndarray, query: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Scores of n documents (rows) for all queries from the documents' words, each with its share; few words, common in pairs, by one product."""
    dense = term < len(matrix)
    table = np.zeros((n, len(matrix)))
    table[doc[dense], term[dense]] = share[dense]
    scores = table @ matrix
    doc, term, share = doc[~dense], term[~dense], share[~dense]
    count = start[term + 1] - start[term]
    # The rest pair by pair, about PAIRS at a time.
    ends = np.cumsum(count)
    at = 0
    while at < len(term):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        c = count[at:to]
        entry = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[term[at:to]], c)
        scores += np.bincount(np.repeat(doc[at:to], c) * scores.shape[1] + query[entry], np.repeat(share[at:to], c) * weight[entry], scores.size).reshape(scores.shape)
        at = to
    return scores


def bm25_many(docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", top_k: int = 10) -> DataFrame:
    """As bm25 without filter, for many and long queries: query_id (long), doc_id, score, rank.

    A join of postings with terms would have a row per query, document and common
    word. Here queries reach the executors in blocks of bounded size, and the
    documents are read once for each block. Words that many queries and documents
    share are scored by a product of matrices, the others by the list of queries
    that have them, for a bounded number of pairs at a time; a task sends on the
    best k of each query only.
    """
    spark = docs.sparkSession
    words = spread(docs.select(id_col, text_col)).select(F.col(id_col).cast("long").alias("doc"), tokenize(F.col(text_col)).alias("words"))
    idf, mean_dl = corpus_statistics(docs, text_col)
    n_docs = max(docs.count(), 1)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(tokenize(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weighed = asked.join(idf, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w"), (F.col("df") / F.lit(n_docs)).alias("share"))
    lists = (F.collect_list(c).alias(a) for c, a in (("term", "terms"), ("w", "w"), ("share", "share")))
    each = cut(weighed.groupBy("query_id").agg(*lists))

    def scan(part: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(_weighted(part))

        def best(batches):
            ids, known, *table = shared.value
            found, step = Best(len(ids), top_k), max(16, min(512, PAIRS // max(len(ids), 1)))
            for batch in batches:
                keys, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                term = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(length)
                for a in range(0, len(keys), step):
                    n = min(step, len(keys) - a)
                    mine, doc = term[ends[a] - length[a] : ends[a + n - 1]], np.repeat(np.arange(n), length[a : a + n])
                    have = mine >= 0
                    pair, tf = np.unique(doc[have] * len(known) + mine[have], return_counts=True)
                    doc, word = pair // max(len(known), 1), pair % max(len(known), 1)
                    scores = _scores(doc, word, tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[a + doc] / (mean_dl or 1.0))), n, *table)
                    found.offer(np.where(scores > 0, scores, -np.inf), keys[a : a + n])
            # A score may be positive and yet round to nothing, as before.
            yield pa.RecordBatch.from_arrays([pa.array(ids[found.q]), pa.array(found.d), pa.array(found.s)], names=["query_id", "doc_id", "score"])

        return words.mapInArrow(best, "query_id long, doc_id long, score double")

    found, block = spark.createDataFrame([], "query_id long, doc_id long, score double"), []
    for r in each.toLocalIterator():
        block.append(r)
        if len(block) == TEXT_BLOCK:
            found, block = found.unionByName(scan(block)), []
    if block:
        found = found.unionByName(scan(block))
    return top(found, ["query_id"], [F.desc("score"), F.asc("doc_id")], top_k)


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank from 1."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def cosine_topk(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", filter_col: str | None = None, top_k: int = 10) -> DataFrame:
    """query_id, vec_id, score, rank by inner product, exhaustively and so exactly.

    Queries reach the executors in blocks of bounded size; vectors are multiplied
    with the block, a bounded number of pairs at a time, and a task sends on the
    best k of each query only, so the shuffle carries no row per pair.
    filter_col, if any, must be equal in query and vector (null in query: any).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), (F.col(filter_col).cast("string") if filter_col else F.lit(None).cast("string")).alias("f"))
    found, block = None, []

    def scan(part: list) -> DataFrame:
        ids, wanted = [q[0] for q in part], [q[2] for q in part]
        matrix = np.array([q[1] for q in part], float)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, wanted, matrix))

        def best(batches):
            ids, wanted, m = shared.value
            ids, number = np.array(ids, np.int64), {f: i for i, f in enumerate(dict.fromkeys(wanted))}
            want, free = np.array([number[f] for f in wanted]), np.array([f is None for f in wanted])
            found, step = Best(len(ids), top_k), max(16, PAIRS // max(len(ids), 1))
            for batch in batches:
                keys, have = batch.column(0).to_numpy(zero_copy_only=False), np.array([-1 if f is None else number.get(f, -1) for f in batch.column(2).to_pylist()])
                if not len(keys):
                    continue
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
                for a in range(0, len(keys), step):
                    scores = x[a : a + step] @ m.T
                    if not free.all():
                        scores[~(free | (have[a : a + step, None] == want))] = -np.inf
                    found.offer(scores, keys[a : a + step])
            yield pa.RecordBatch.from_arrays([pa.array(ids[found.q]), pa.array(found.d), pa.array(found.s)], names=["query_id", "vec_id", "score"])

        return rows.where("v is not null").mapInArrow(best, "query_id long, vec_id long, score double")

    source = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"), (F.col(filter_col).cast("string") if filter_col else F.lit(None).cast("string")))
    for q in source.toLocalIterator():
        block.append(q)
        if len(block) == QUERY_BLOCK:
            found, block = scan(block) if found is None else found.unionByName(scan(block)), []
    if block or found is None:
        part = scan(block) if block else vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    return top(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], top_k)


def document_search(queries: DataFrame, documents: DataFrame, vectors: DataFrame, top_k: int, filter_col: str = "destination_id") -> DataFrame:
    """query_id, retriever, doc_id, rank: the semantic and the keyword list of each query.

    queries: query_id (long), query, vector and filter_col. documents: doc_id,
    text and filter_col. vectors: vec_id, embedding and filter_col. A query
    without a vector has no semantic list.
    """
    semantic = cosine_topk(vectors, queries.where("vector is not null"), filter_col=filter_col, top_k=top_k).select("query_id", F.lit("semantic").alias("retriever"), F.col("vec_id").alias("doc_id"), "rank")
    keyword = bm25(documents, queries.select("query_id", "query", filter_col), filter_col=filter_col, top_k=top_k).select("query_id", F.lit("keyword").alias("retriever"), "doc_id", "rank")
    return semantic.unionByName(keyword)


def reciprocal_rank_fusion(lists: DataFrame, top_k: int, config: str = "fusion") -> DataFrame:
    """lists: query_id, retriever, doc_id, rank[, payload] -> query_id, doc_id, score, sources, payload, rank.

    The score is the sum of 1 / (60 + rank); ties go to the document met first
    (semantic, keyword, graph; then rank). The payload is that of the last list.
    An unknown configuration is an error; `standard` retrieves nothing.
    """
    if config not in CONFIGS:
        raise ValueError(f"unknown configuration: {config}")
    lists = lists.where(F.col("retriever").isin(*CONFIGS[config])) if CONFIGS[config] else lists.where(F.lit(False))
    if "payload" not in lists.columns:
        lists = lists.withColumn("payload", F.lit(None).cast("string"))
    order = F.coalesce(*(F.when(F.col("retriever") == k, F.lit(v)) for k, v in LIST_ORDER.items()))
    fused = lists.withColumn("lo", order).groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))), 9).alias("score"),
        F.concat_ws(",", F.array_sort(F.collect_set("retriever"))).alias("sources"),
        F.max_by("payload", "lo").alias("payload"),
        F.min(F.struct("lo", "rank")).alias("met"),
    )
    return top(fused, ["query_id"], [F.desc("score"), F.asc("met"), F.asc("doc_id")], top_k).drop("met")


def narrate(hits: DataFrame, most: int = 6) -> DataFrame:
    """query_id, narrative: the first six texts as bullets; a fixed text where a query found nothing is the caller's."""
    return hits.where(F.col("rank") <= most).groupBy("query_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", "payload"))), lambda x: F.concat(F.lit("- "), x["payload"]))).alias("narrative"))
