"""Streaming forms, run until the given files are used up and read back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.plans import views
from martwright.plans.ingest import FIRST
from martwright.plans.registry import query
from martwright.session import scratch_dir
from martwright.streaming.streams import (
    set_clock,
    stream_abandoned_carts,
    stream_append,
    stream_daily_checks,
    stream_distinct_append,
)


def _source(root: str) -> str:
    """A pattern, so that the table may be one file or a folder of files."""
    return f"{root}/events.parquet*"


@query("SELECT *, TIMESTAMP '2024-01-31 00:00:00' AS _loaded_at FROM events")
def stream_append_ingest(spark: SparkSession, root: str) -> DataFrame:
    """The second run finds no new file and adds nothing."""
    folder = scratch_dir(spark, "stream_append")
    schema = views.events(spark, root).schema
    for _ in range(2):
        stream_append(
            spark,
            _source(root),
            schema,
            f"{folder}/raw_events",
            f"{folder}/checkpoint",
            FIRST,
        )
    return spark.read.parquet(f"{folder}/raw_events")


@query("""
SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events c
WHERE event_type = 'click' AND user_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase'
                  AND p.user_id = c.user_id AND CAST(p.ts AS DATE) = CAST(c.ts AS DATE))
""")
def stream_abandoned(spark: SparkSession, root: str) -> DataFrame:
    """``abandoned_carts`` as a stream; a row of the clock ends the last windows in a second run."""
    folder = scratch_dir(spark, "stream_abandoned")
    schema = views.events(spark, root).schema
    set_clock(spark, f"{folder}/clock", schema, "ts", views.EVENTS_AS_OF - timedelta(days=366))
    for end in (None, views.EVENTS_AS_OF + timedelta(days=7)):
        if end:
            set_clock(spark, f"{folder}/clock", schema, "ts", end)
        stream_abandoned_carts(
            spark,
            _source(root),
            f"{folder}/clock",
            schema,
            f"{folder}/abandoned",
            f"{folder}/checkpoint",
            key=["user_id", "CASE WHEN user_id IS NOT NULL THEN CAST(ts AS DATE) END"],
            cart="event_type = 'click'",
            checkout="event_type = 'purchase'",
        )
    found = spark.read.parquet(f"{folder}/abandoned")
    return found.select(F.col("k0").alias("user_id"), F.col("k1").alias("day"))


@query("""
SELECT event_type, COUNT(*) AS events, COUNT(DISTINCT event_id) AS distinct_events,
       CAST(SUM(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1
""")
def stream_distinct_events(spark: SparkSession, root: str) -> DataFrame:
    """Every event is delivered by two sources; each counts once."""
    folder = scratch_dir(spark, "stream_distinct")
    events = views.events(spark, root)
    for _ in range(2):
        events.write.mode("append").parquet(f"{folder}/delivered")
    stream_distinct_append(
        spark,
        f"{folder}/delivered",
        events.schema,
        f"{folder}/events",
        f"{folder}/checkpoint",
        key=["event_id"],
        keep="60 days",
    )
    return (
        spark.read.parquet(f"{folder}/events")
        .groupBy("event_type")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_distinct("event_id").alias("distinct_events"),
            F.sum("event_id").alias("id_sum"),
        )
    )


@query("""
SELECT CAST(ts AS DATE) AS day, COUNT(*) AS row_count,
       COUNT(*) FILTER (WHERE value IS NULL) AS null_values, MAX(ts) AS newest
FROM events GROUP BY 1
""")
def stream_daily_volume(spark: SparkSession, root: str) -> DataFrame:
    folder = scratch_dir(spark, "stream_daily")
    stream_daily_checks(
        spark,
        _source(root),
        views.events(spark, root).schema,
        f"{folder}/daily",
        f"{folder}/checkpoint",
    )
    return spark.read.parquet(f"{folder}/daily")
