"""Evaluation of retrieval configurations and of forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .prep import fuzzy_matches


def recall(hits: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """by..., n_gold, n_hit, recall: the share of the gold set (query_id, doc_id) found; null where it is empty.

    hits: by... (which has query_id) and doc_id.
    """
    keys = hits.select(*by).distinct()
    g = gold.select("query_id", "doc_id").distinct()
    sizes = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    found = hits.select(*by, "doc_id").distinct().join(g, ["query_id", "doc_id"], "left_semi").groupBy(*by).agg(F.count("*").alias("n_hit"))
    out = keys.join(sizes, "query_id", "left").join(found, by, "left")
    n, h = F.coalesce("n_gold", F.lit(0)).cast("long"), F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(*by, n.alias("n_gold"), h.alias("n_hit"), F.when(n > 0, F.round(h / n, 6)).alias("recall"))


def precision(hits: DataFrame, liked: DataFrame, by: list[str]) -> DataFrame:
    """by..., precision: the share of hits whose category is among those liked (query_id, category); 0 without hits."""
    marked = hits.join(liked.select("query_id", "category").distinct().withColumn("good", F.lit(1.0)), ["query_id", "category"], "left")
    return marked.groupBy(*by).agg(F.round(F.coalesce(F.avg(F.coalesce("good", F.lit(0.0))), F.lit(0.0)), 3).alias("precision"))


def grounded(hits: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """by..., grounded: 1 if any hit is a known place, else 0."""
    marked = hits.join(known.select("doc_id").distinct().withColumn("ok", F.lit(1.0)), "doc_id", "left")
    return marked.groupBy(*by).agg(F.coalesce(F.max("ok"), F.lit(0.0)).alias("grounded"))


def km_per_stop(days: DataFrame, by: list[str]) -> DataFrame:
    """by..., km_per_stop: null without stops and for 0 km. days: by..., km, n_stops."""
    each = F.col("km") / F.when(F.col("n_stops") > 0, F.col("n_stops"))
    return days.select(*by, F.when(each != 0, F.round(each, 3)).alias("km_per_stop"))


def summarize(results: DataFrame, metrics: list[str], order: list[str], digits: int = 3) -> DataFrame:
    """config, ord and the mean of each metric, nulls left out, configurations in the given order."""
    place = F.coalesce(*(F.when(F.col("config") == c, F.lit(i)) for i, c in enumerate(order)))
    return results.groupBy("config").agg(*(F.round(F.avg(m), digits).alias(m) for m in metrics)).withColumn("ord", place)


def grounding_probe(answers: DataFrame, names: DataFrame) -> DataFrame:
    """destination_id, named, matched: lines of stored answers (destination_id, text), and those that fit a known place's name.

    A line's bullets and blank ends don't count, blank lines neither; a name
    fits if either lies in the other, without regard to case.
    """
    lines = answers.select("destination_id", F.posexplode(F.split("text", r"\R")).alias("at", "line")).withColumn("line", F.regexp_replace("line", r"^[-* ]+|[-* ]+$", ""))
    lines = lines.where(F.trim("line") != "").withColumn("line_id", F.struct("destination_id", "at"))
    found = fuzzy_matches(lines.select("line_id", "line"), names)
    return found.groupBy(F.col("line_id.destination_id").alias("destination_id")).agg(F.count("*").alias("named"), F.count(F.when(F.col("matched"), 1)).alias("matched"))
