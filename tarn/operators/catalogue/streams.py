"""Event-time windows over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.registry import query, table
from tarn.operators.catalogue.lake import _scratch
from tarn.streaming import drain, session_counts, sliding_counts, tumbling_counts


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_counts(table(spark, sf_dir, "events"), "1 hour", ["event_type"])


@query("SELECT time_bucket(INTERVAL '1 hour', ts) - o.i * INTERVAL '1 hour' AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) o(i) GROUP BY ALL")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding_counts(table(spark, sf_dir, "events"), "2 hours", "1 hour", ["event_type"])


@query(
    """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
       s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m)
       SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, g"""
)
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_counts(table(spark, sf_dir, "events"), "30 minutes", ["user_id"])


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, count(*) AS n FROM events GROUP BY user_id")
def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum((F.col("event_type") == "click").cast("int")).alias("clicks"), F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a stream of files, counted with a watermark, all that is there drained."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return drain(tumbling_counts(stream, "6 hours", ["event_type"], late="10 days"), _scratch(spark, "stream"), "complete")
