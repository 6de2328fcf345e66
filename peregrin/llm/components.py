"""Connected components of an edge table, without the driver seeing an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise, release


def connected_components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """edges (u, v) -> (node, root), root the smallest node of the component; node <> root.

    Alternates large-star and small-star steps until nothing changes: each
    replaces a node's edges by edges to its smallest neighbour, so hot nodes are
    aggregated, never collected, and the rounds grow with the logarithm of the
    longest path. Each round's edges are written to the shared folder.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        after = materialise(_small_star(_large_star(now)), "edges")
        release(now)
        now = after
    raise RuntimeError("components did not settle")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("x")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "x"), F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
