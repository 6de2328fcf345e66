"""The registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..streaming import demand as stream_demand
from . import compare, connectors, demand_routing, prep_eval, retrieval_graph, scaled, trip

PARTS = (retrieval_graph, demand_routing, prep_eval, connectors, trip, compare, scaled, stream_demand)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword, vector and graph retrieval, fused."""
    return retrieval_graph.rrf_fusion(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, s in part.SQL.items()}
