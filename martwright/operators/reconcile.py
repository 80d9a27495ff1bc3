"""Reconciliation of warehouse values with values reported elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relative difference under which a source passes, and under which it warns.
PASS_BELOW = 0.02
WARN_BELOW = 0.10
WAREHOUSE = "warehouse"


def drift(warehouse: Column, other: Column) -> Column:
    """(other - warehouse) / warehouse; 0 when there is no warehouse value to compare with."""
    return F.when(warehouse.isNull() | (warehouse == 0), F.lit(0.0)).otherwise(
        F.try_divide(other - warehouse, warehouse)
    )


def band(delta: Column) -> Column:
    return (
        F.when(F.abs(delta) < PASS_BELOW, "pass")
        .when(F.abs(delta) < WARN_BELOW, "warn")
        .otherwise("fail")
    )


def reconcile(metrics: DataFrame, warehouse: DataFrame, external: DataFrame) -> DataFrame:
    """One warehouse row per metric (position 0) and one row per source.

    ``metrics`` (metric), ``warehouse`` (metric, value) and ``external`` (metric, source,
    value, error). A source that failed keeps its error and does not touch the others.
    """
    known = metrics.select("metric").distinct().join(
        warehouse.select("metric", F.col("value").cast("double").alias("warehouse_value")),
        "metric",
        "left",
    )
    first = known.select(
        "metric",
        F.lit(0).alias("position"),
        F.lit(WAREHOUSE).alias("source"),
        "warehouse_value",
        F.col("warehouse_value").alias("value"),
        F.lit(0.0).alias("delta"),
        F.lit("pass").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )
    delta = F.when(F.col("error").isNull(), drift(F.col("warehouse_value"), F.col("value")))
    others = (
        external.select("metric", "source", F.col("value").cast("double").alias("value"), "error")
        .join(known, "metric")
        .withColumn("delta", delta)
        .select(
            "metric",
            F.lit(1).alias("position"),
            "source",
            "warehouse_value",
            "value",
            "delta",
            F.when(F.col("error").isNotNull(), "fail").otherwise(band(F.col("delta"))).alias("status"),
            "error",
        )
    )
    return first.unionByName(others)


def reconcile_by_dimension(
    warehouse: DataFrame, external: DataFrame, dimensions: list[str]
) -> DataFrame:
    """Group by group; a group missing on one side fails, whichever side it is."""
    left = warehouse.select(*dimensions, F.col("value").cast("double").alias("warehouse_value"))
    right = external.select(*dimensions, F.col("value").cast("double").alias("external_value"))
    missing = F.col("warehouse_value").isNull() | F.col("external_value").isNull()
    return (
        left.join(right, dimensions, "full_outer")
        .withColumn(
            "delta",
            F.when(~missing, drift(F.col("warehouse_value"), F.col("external_value"))),
        )
        .withColumn("status", F.when(missing, "fail").otherwise(band(F.col("delta"))))
    )
