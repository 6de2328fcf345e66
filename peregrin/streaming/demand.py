"""Demand as a stream: windows over events with a watermark, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; its schema is taken from the files that are there."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_demand(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, event_type, n, value per tumbling window; rows later than the watermark are left out of a stream."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """user_id, session_start, n per session."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def write_demand(stream: DataFrame, path: str, checkpoint: str):
    """Appends closed windows to Parquet, exactly once; processes what is there and stops."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = windowed_demand(_events(spark, d))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "value")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = sessions(_events(spark, d))
    return rows.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {f.__name__: f for f in (event_windows, event_sessions)}
SQL = {
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
      SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""",
}
