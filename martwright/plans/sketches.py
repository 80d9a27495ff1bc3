"""Windows answered from stored daily sketches, beside the exact figures that they stand for."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.operators import sketches
from martwright.plans import views
from martwright.plans.registry import query
from martwright.session import cut_lineage

FIRST, LAST = date(2024, 1, 3), date(2024, 1, 28)
# Three standard errors of the distinct counts, and the stated rank error with some room.
KEYS_WITHIN, RANK_WITHIN = 0.05, 0.03


@query(f"""
WITH w AS (SELECT * FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}')
SELECT event_type, COUNT(DISTINCT CAST(ts AS DATE)) AS days, COUNT(*) AS rows,
       COUNT(DISTINCT user_id) AS distinct_keys, TRUE AS keys_within, TRUE AS median_within
FROM w GROUP BY 1
""")
def sketched_window(spark: SparkSession, root: str) -> DataFrame:
    """Users and median value per event type over weeks, exact and from one stored row per day."""
    events = views.events(spark, root)
    days = cut_lineage(sketches.by_day(events, "ts", "user_id", "value", ["event_type"]))
    merged = sketches.over(days, FIRST, LAST, by=["event_type"])
    day = F.col("ts").cast("date")
    exact = (
        events.where(day.between(F.lit(FIRST), F.lit(LAST)))
        .join(merged.select("event_type", "quantile"), "event_type")
        .groupBy("event_type")
        .agg(
            F.count_distinct("user_id").alias("exact_keys"),
            F.count("value").alias("n"),
            F.count_if(F.col("value") <= F.col("quantile")).alias("upto"),
            F.count_if(F.col("value") < F.col("quantile")).alias("below"),
        )
    )
    wrong = F.abs(F.col("distinct_keys") - F.col("exact_keys"))
    half = F.col("n") / 2
    slack = F.col("n") * RANK_WITHIN + 1
    return merged.join(exact, "event_type").select(
        "event_type",
        "days",
        "rows",
        F.col("exact_keys").alias("distinct_keys"),
        (wrong <= F.col("exact_keys") * KEYS_WITHIN + 1).alias("keys_within"),
        ((F.col("upto") >= half - slack) & (F.col("below") <= half + slack)).alias("median_within"),
    )
