"""Scores and summaries over check results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.functions.values import ERROR, FAILED, PASSED, WARNING, score_points, worst_status


def metric_scores(results: DataFrame) -> DataFrame:
    """Per metric: points, number of rules, share, worst status and scorecard word."""
    return (
        results.groupBy("metric")
        .agg(
            F.sum(score_points(F.col("status"))).alias("trust_score"),
            F.count(F.lit(1)).alias("trust_total"),
            worst_status(F.col("status")).alias("status"),
            F.count_if(F.col("status").isin(FAILED, ERROR)).alias("failed"),
        )
        .withColumn("score_pct", F.round(100.0 * F.col("trust_score") / F.col("trust_total"), 0))
        .withColumn("scorecard", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))
    )


def suite_summary(scores: DataFrame) -> DataFrame:
    """Healthy, warning and failing metrics; warnings alone do not fail a run."""
    status = F.col("status")
    return scores.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == PASSED).alias("healthy"),
        F.count_if(status == WARNING).alias("warning"),
        F.count_if(status.isin(FAILED, ERROR)).alias("failing"),
    ).withColumn("exit_code", F.when(F.col("failing") > 0, 1).otherwise(0))
