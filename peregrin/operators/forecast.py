"""Monthly demand: spine, crowding, Holt-Winters, backtests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scoring import crowding_level
from . import smoothing
from .retrieval import top

SEASON = 12
#: Smoothing of level, trend and season, and damping, where no fit is asked for.
FIXED = (0.3, 0.1, 0.2, 0.98)
#: Most changes of slope, the part of the history that may have them, and the spreads of the priors.
CHANGES, CHANGE_RANGE = 25, 0.8
CHANGE_SPREAD, TREND_SPREAD, SEASON_SPREAD = 0.05, 5.0, 10.0


def month_spine(series: DataFrame) -> DataFrame:
    """key, month, value: every month from a series' first to its last, gaps null."""
    ends = series.groupBy("key").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    spine = ends.select("key", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return spine.join(series.select("key", "month", "value"), ["key", "month"], "left")


def history_stats(series: DataFrame) -> DataFrame:
    """key, mean, std (of the sample) over months that have a value."""
    return series.groupBy("key").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def crowding(rows: DataFrame, stats: DataFrame, value: str = "value") -> DataFrame:
    """rows with crowding_z and crowding_level; a constant series has null for both."""
    z = (F.col(value) - F.col("mean")) / F.when(F.col("std") > 0, F.col("std"))
    out = rows.join(stats, "key").withColumn("crowding_z", F.round(z, 6)).withColumn("crowding_level", crowding_level(F.col("crowding_z")))
    return out.drop("mean", "std")


def as_array(series: DataFrame) -> DataFrame:
    """key, first month, values in order: one row per series, which is as long as its months."""
    rows = series.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("month", "value"))).alias("s"))
    return rows.select("key", F.col("s")[0]["month"].alias("first"), F.transform("s", lambda x: x["value"]).alias("values"))


def holt_winters_fold(values: Column, alpha: float, beta: float, gamma: float, phi: float, horizon: int) -> Column:
    """Forecasts of additive damped Holt-Winters as a fold over the array, within Catalyst.

    Starts from the first year's mean, no trend and its deviations; needs 12 values.
    """
    year = F.slice(values, 1, SEASON)
    mean = F.aggregate(year, F.lit(0.0), lambda a, x: a + x) / F.lit(float(SEASON))
    start = F.struct(mean.alias("l"), F.lit(0.0).alias("b"), F.transform(year, lambda x: x - mean).alias("s"))

    def step(acc, x):
        season = acc["s"][0]
        level = F.lit(alpha) * (x - season) + F.lit(1 - alpha) * (acc["l"] + F.lit(phi) * acc["b"])
        trend = F.lit(beta) * (level - acc["l"]) + F.lit(1 - beta) * F.lit(phi) * acc["b"]
        new = F.lit(gamma) * (x - level) + F.lit(1 - gamma) * season
        return F.struct(level.alias("l"), trend.alias("b"), F.concat(F.slice(acc["s"], 2, SEASON - 1), F.array(new)).alias("s"))

    rest = F.slice(values, SEASON + 1, F.greatest(F.size(values) - SEASON, F.lit(0)))
    damp = [sum(phi ** (i + 1) for i in range(h)) for h in range(1, horizon + 1)]
    end = lambda acc: F.array(*(acc["l"] + F.lit(damp[h]) * acc["b"] + acc["s"][h % SEASON] for h in range(horizon)))
    return F.aggregate(rest, start, step, end)


def forecast_fixed(series: DataFrame, horizon: int = 12, parameters: tuple = FIXED) -> DataFrame:
    """key, month, forecast with fixed parameters; series under 12 months or with gaps have no rows."""
    whole = as_array(series).where((F.size("values") >= SEASON) & ~F.exists("values", lambda x: x.isNull()))
    rows = whole.select("key", "first", F.size("values").alias("n"), F.posexplode(holt_winters_fold(F.col("values"), *parameters, horizon)).alias("h", "forecast"))
    return rows.select("key", F.add_months("first", F.col("n") + F.col("h")).alias("month"), F.col("forecast"))


def fit_changepoints(values: list[float], horizon: int, rounds: int = 50) -> np.ndarray:
    """Forecast of a trend whose slope may change, plus a season: the most probable parameters.

    Slopes change at up to CHANGES months, evenly over the first CHANGE_RANGE of
    the history, under a Laplace prior that keeps most changes at nothing; slope,
    offset and the season's six Fourier pairs (months have no higher ones) have
    normal priors. The prior on changes enters as weights of least squares,
    renewed from the last solution, as does the noise.
    """
    y = np.array(values, float)
    n, scale = len(y), np.abs(y).max() or 1.0
    t = np.arange(n + horizon) / max(1, n - 1)
    early = int(n * CHANGE_RANGE)
    at = np.unique(np.linspace(0, early - 1, min(CHANGES, early - 1) + 1).round().astype(int)[1:])
    waves = [f(2 * np.pi * k * np.arange(n + horizon) / SEASON) for k in range(1, SEASON // 2 + 1) for f in (np.sin, np.cos)]
    x = np.column_stack([np.ones(n + horizon), t, np.maximum(0, t[:, None] - t[at]), *waves])
    known, target = x[:n], y / scale
    change = slice(2, 2 + len(at))
    weight = np.full(x.shape[1], 1 / SEASON_SPREAD**2)
    weight[:2] = 1 / TREND_SPREAD**2
    size, noise = np.full(len(at), CHANGE_SPREAD), 0.01
    for _ in range(rounds):
        weight[change] = 1 / (CHANGE_SPREAD * np.maximum(size, 1e-6))
        found = np.linalg.solve(known.T @ known / noise + np.diag(weight), known.T @ target / noise)
        size, noise = np.abs(found[change]), max(1e-8, float(((target - known @ found) ** 2).mean()))
    return x[n:] @ found * scale


def forecast_fitted(series: DataFrame, horizon: int = 12, model: str = "holt_winters") -> DataFrame:
    """key, month, forecast of a fitted model; series under 24 months or with gaps have no rows.

    model: holt_winters, whose smoothing and first states are fitted for all series
    of a batch at once, or `trend_season`, a trend with changes of slope and a
    yearly season. A series is one row, as long as its months.
    """
    if model not in ("holt_winters", "trend_season"):
        raise ValueError(f"unknown model: {model}")
    whole = as_array(series.select("key", "month", F.col("value").cast("double").alias("value"))).where((F.size("values") >= 2 * SEASON) & ~F.exists("values", lambda x: x.isNull() | F.isnan(x)))

    def guess(batches):
        for batch in batches:
            values = batch.column(2).to_pylist()
            lengths = np.array([len(v) for v in values])
            out = np.empty((len(values), horizon))
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                rows = [values[i] for i in at]
                out[at] = smoothing.fit(np.array(rows), horizon)[0] if model == "holt_winters" else [fit_changepoints(v, horizon) for v in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int32()), pa.array(list(out), pa.list_(pa.float64()))], names=["key", "first", "n", "forecasts"])

    kind = series.schema["key"].dataType.simpleString()
    made = whole.mapInArrow(guess, f"key {kind}, first date, n int, forecasts array<double>")
    rows = made.select("key", "first", "n", F.posexplode("forecasts").alias("h", "forecast"))
    return rows.select("key", F.add_months("first", F.col("n") + F.col("h")).alias("month"), "forecast")


def best_months(forecasts: DataFrame, stats: DataFrame, top_k: int = 3) -> DataFrame:
    """The months of least crowding: key, month, forecast, crowding_z, crowding_level, rank."""
    rows = crowding(forecasts, stats, "forecast")
    return top(rows, ["key"], [F.asc_nulls_last("crowding_z"), F.asc("month")], top_k)


def pick_month(forecasts: DataFrame, wanted: Column) -> DataFrame:
    """The forecast row of the wanted month, else the first one; month_matched says which."""
    hit = F.coalesce(F.date_format("month", "yyyy-MM") == wanted, F.lit(False))
    return top(forecasts.withColumn("month_matched", hit), ["key"], [F.desc("month_matched"), F.asc("month")], 1).drop("rank")


def split_hold_out(series: DataFrame, months: int) -> DataFrame:
    """series with is_test: true for each series' last months."""
    back = F.row_number().over(W.partitionBy("key").orderBy(F.desc("month")))
    return series.withColumn("is_test", back <= months)


def errors(rows: DataFrame, truth: str = "value", guess: str = "forecast", by: tuple[str, ...] = ("key",)) -> DataFrame:
    """mae and rmse per group."""
    e = F.col(guess) - F.col(truth)
    return rows.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def seasonal_naive(series: DataFrame, months: int = 6) -> DataFrame:
    """key, month, value, forecast: the hold-out months with the value a year before."""
    marked = split_hold_out(series, months)
    past = marked.where("not is_test").select("key", F.add_months("month", SEASON).alias("month"), F.col("value").alias("forecast"))
    return marked.where("is_test").join(past, ["key", "month"], "left").select("key", "month", "value", "forecast")


def backtest(series: DataFrame, months: int = 6, model: str = "holt_winters") -> DataFrame:
    """key, model, mae, rmse of a model that has not seen each series' last months."""
    marked = split_hold_out(series, months)
    guess = forecast_fitted(marked.where("not is_test"), months, model)
    rows = marked.where("is_test").join(guess, ["key", "month"])
    return errors(rows).withColumn("model", F.lit(model))
