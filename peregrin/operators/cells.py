"""Exact vector search that leaves out whole cells by the triangle inequality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from . import lloyd
from .retrieval import top

#: Vectors that centres are fitted on, at most; centres, at most; vectors of a part of a cell, about.
SAMPLE, MOST_CELLS, PART = 20_000, 1024, 4096
#: Queries that a part of a cell meets at a time, about.
QUERIES = 2048
#: Scores are compared rounded to six places; a bound gives way by more than that.
SLACK = 2e-6


def make_cells(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, seed: int = 7) -> tuple[DataFrame, np.ndarray, list[tuple]]:
    """The vectors with their cell and part, the centres, and (cell, vectors, parts, radius) of each cell.

    Centres come from at most SAMPLE vectors (the smallest hashes of the id);
    every vector is put into the cell of the nearest centre. There are about as
    many cells as the square root of the vectors, at most MOST_CELLS; that is
    what the driver holds. Rows without a vector are left out.
    """
    rows = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    n = rows.count()
    cells = cells or max(1, min(MOST_CELLS, int(np.sqrt(n))))
    share = min(1.0, 1.2 * SAMPLE / max(1, n))
    bound = min(2**63 - 1, int(share * 2**64) - 2**63)
    sample = rows.where(F.xxhash64(F.lit(seed), "vec_id") <= bound).select("v").persist()
    centres, _ = lloyd.kmeans(sample, cells, tries=1, rounds=5, seed=seed)
    sample.unpersist()

    def put(batches):
        for batch in batches:
            x = lloyd.as_matrix(batch.column(1))
            # Distances by subtraction, as a radius must not be too small.
            near = lloyd.gaps(x, centres).argmin(1) if len(x) else np.empty(0, int)
            far = np.sqrt(((x - centres[near]) ** 2).sum(1)) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "cell", "far"])

    placed = cut(rows.mapInArrow(put, "vec_id long, v array<double>, cell int, far double"))
    table = [tuple(r) for r in placed.groupBy("cell").agg(F.count("*"), F.ceil(F.count("*") / F.lit(PART)).cast("int"), F.max("far")).collect()]
    parts = F.element_at(F.create_map(*(F.lit(x) for c, _, p, _ in table for x in (c, p))), F.col("cell")) if table else F.lit(1)
    return placed.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part")), centres, table


def _search(asked: DataFrame, placed: DataFrame, parts: dict[int, int], top_k: int) -> DataFrame:
    """query_id, vec_id, score: the best of each part of a cell for each query that meets it. asked: query_id, v, cell."""
    n = F.element_at(F.create_map(*(F.lit(x) for c, p in parts.items() for x in (c, p))), F.col("cell"))
    met = asked.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))

    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and rows.num_rows:
            ids, x = rows["vec_id"].to_numpy(), lloyd.as_matrix(rows["v"].combine_chunks())
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            for at in range(0, queries.num_rows, QUERIES):
                part = queries.slice(at, QUERIES)
                scores = np.round(lloyd.as_matrix(part["v"].combine_chunks()) @ x.T, 6)
                # Ids ascend, so a stable sort puts the smaller of equal scores first.
                pick = np.argsort(-scores, axis=1, kind="stable")[:, :top_k]
                out["query_id"].append(np.repeat(part["query_id"].to_numpy(), pick.shape[1]))
                out["vec_id"].append(ids[pick].ravel())
                out["score"].append(np.take_along_axis(scores, pick, 1).ravel())
        return pa.table({k: pa.array(np.concatenate(v) if v else [], pa.float64() if k == "score" else pa.int64()) for k, v in out.items()})

    return met.groupBy("cell", "part").cogroup(placed.groupBy("cell", "part")).applyInArrow(best, "query_id long, vec_id long, score double")


def cosine_pruned(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", top_k: int = 10, cells: int | None = None, counts: dict | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: as cosine_topk without a filter, but a query meets only cells that may hold one of its best.

    A vector's inner product with a query differs from its centre's by no more
    than the query's length times the cell's radius. A query first meets the
    cells that promise most, until they hold top_k vectors; the worst of the best
    found there is its threshold, and of the other cells it meets those whose
    bound reaches it. Queries and cells meet in a join, so neither passes through
    the driver. counts: gets `met` and `all`, the pairs looked at and all pairs.
    """
    spark = vectors.sparkSession
    placed, centres, table = make_cells(vectors, id_col=id_col, vector_col=vector_col, cells=cells)
    asked = queries.where(F.col("vector").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("v"))
    if not table:
        return spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    known = np.array(sorted(table), float)
    shared = spark.sparkContext.broadcast((known[:, 0].astype(int), known[:, 1], known[:, 3], centres))

    def bounds(batches):
        number, size, radius, centre = shared.value
        for batch in batches:
            q = lloyd.as_matrix(batch.column(1))
            most = q @ centre[number].T + np.sqrt((q**2).sum(1))[:, None] * radius
            order = np.argsort(-most, axis=1, kind="stable")
            # The first cells, in order of promise, that together hold top_k vectors.
            before = np.cumsum(size[order], axis=1) - size[order]
            first = np.zeros(most.shape, bool)
            np.put_along_axis(first, order, before < top_k, 1)
            i, c = np.divmod(np.arange(most.size), most.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(number[c].astype(np.int32)), pa.array(most.ravel()), pa.array(first.ravel())], names=["query_id", "v", "cell", "most", "first"])

    pairs = cut(asked.mapInArrow(bounds, "query_id long, v array<double>, cell int, most double, first boolean"))
    parts = {c: p for c, _, p, _ in table}
    found = cut(top(_search(pairs.where("first").select("query_id", "v", "cell"), placed, parts, top_k), ["query_id"], [F.desc("score"), F.asc("vec_id")], top_k).drop("rank"))
    threshold = found.groupBy("query_id").agg(F.min("score").alias("t"), F.count("*").alias("n"))
    more = pairs.where("not first").join(threshold, "query_id", "left").where(F.coalesce(F.col("n") < top_k, F.lit(True)) | (F.col("most") >= F.col("t") - SLACK)).select("query_id", "v", "cell")
    if counts is not None:
        sizes = spark.createDataFrame([(c, n) for c, n, _, _ in table], "cell int, n long")
        counts["met"] = pairs.where("first").select("cell").unionByName(more.select("cell")).join(F.broadcast(sizes), "cell").agg(F.sum("n")).first()[0]
        counts["all"] = asked.count() * sum(n for _, n, _, _ in table)
    return top(found.unionByName(_search(more, placed, parts, top_k)), ["query_id"], [F.desc("score"), F.asc("vec_id")], top_k)
