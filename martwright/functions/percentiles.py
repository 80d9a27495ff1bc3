"""Exact percentile that never holds the values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_percentile(df: DataFrame, value: Column, fraction: float, name: str) -> DataFrame:
    """One row with the linearly interpolated percentile of a bigint ``value``.

    The built-in exact percentile keeps a map of all distinct values in one task.
    Here equal values are counted first, then the wanted rank is narrowed down by 16 bits at a
    time. The first step ranks at most 65,536 buckets, each further one as many in each of
    the one or two buckets kept.
    """
    counts = (
        df.select(value.cast("bigint").alias("v"))
        .filter(F.col("v").isNotNull())
        .groupBy("v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    high = counts.groupBy(F.shiftright("v", 48).alias("b0")).agg(F.sum("n").alias("n"))
    upto = Window.orderBy("b0").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("b0").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    place = F.lit(float(fraction)) * (F.sum("n").over(everything) - 1)
    high = high.withColumn("place", place).withColumn(
        "before", F.coalesce(F.sum("n").over(upto), F.lit(0))
    )
    holds = (F.col("before") <= F.ceil("place")) & (F.col("before") + F.col("n") > F.floor("place"))
    kept = high.filter(holds).select("b0", "place", "before")
    for step, shift in enumerate((48, 32, 16)):
        bucket, finer = f"b{step}", "v" if shift == 16 else f"b{step + 1}"
        low = _refine(counts, kept, bucket, shift, finer, shift - 16).filter(holds)
        kept = low.select(finer, "place", "before")

    at = lambda rank: F.max(
        F.when((F.col("before") <= rank) & (F.col("before") + F.col("n") > rank), F.col("v"))
    )
    return (
        low.agg(
            at(F.floor("place")).alias("lo"),
            at(F.ceil("place")).alias("hi"),
            F.max(F.col("place") - F.floor("place")).alias("part"),
        )
        .select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias(name))
    )


def _refine(
    counts: DataFrame, kept: DataFrame, bucket: str, shift: int, finer: str, finer_shift: int
) -> DataFrame:
    """Rank the finer buckets inside the one or two kept buckets."""
    inside = counts.withColumn(bucket, F.shiftright("v", shift)).join(kept, bucket)
    inside = inside.withColumn(finer, F.shiftright("v", finer_shift) if finer_shift else F.col("v"))
    upto = Window.partitionBy(bucket).orderBy(finer).rowsBetween(Window.unboundedPreceding, -1)
    return (
        inside.groupBy(bucket, finer)
        .agg(F.sum("n").alias("n"), F.max("place").alias("place"), F.max("before").alias("start"))
        .withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
    )
