"""Row-to-row comparisons that split the rows of one key over many tasks.

A plain window sends every row of a key to one task. Here the order of a key is
cut into chunks (``chunk`` grows with the order column), each chunk is handled on
its own, and only one summary row per chunk is compared across chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    chunk: Column | list[Column],
    name: str,
) -> DataFrame:
    """Add ``name``: ``value`` of the previous row of the key, NULL on the first row.

    ``chunk`` may be several columns from fine to coarse: the last rows of the fine chunks
    are then compared in coarser chunks, and so on, so that no task gets all of them.
    """
    fine, *coarser = chunk if isinstance(chunk, list) else [chunk]
    at, last, carried = (f"_{part}{len(coarser)}" for part in ("chunk", "last", "carried"))
    cut = [*keys, at]
    above = [c.alias(f"_above{i}") for i, c in enumerate(coarser)]
    rows = df.withColumn(last, value).withColumn(at, fine)
    inside = Window.partitionBy(*cut).orderBy(order)
    ends = (
        df.select(*keys, F.col(order).alias("_order"), value.alias(last), fine.alias(at), *above)
        .groupBy(*cut)
        .agg(
            F.max_by(last, "_order").alias(last),
            *(F.max(f"_above{i}").alias(f"_above{i}") for i in range(len(coarser))),
        )
    )
    if coarser:
        names = [f"_above{i}" for i in range(len(coarser))]
        ends = with_previous(ends, keys, at, F.col(last), [F.col(n) for n in names], carried)
        ends = ends.drop(last, *names)
    else:
        before = F.lag(last).over(Window.partitionBy(*keys).orderBy(at))
        ends = ends.withColumn(carried, before).drop(last)
    rows = rows.withColumn("_lag", F.lag(last).over(inside)).withColumn(
        "_head", F.row_number().over(inside) == 1
    )
    return (
        rows.join(ends, cut, "left")
        .withColumn(name, F.when(F.col("_head"), F.col(carried)).otherwise(F.col("_lag")))
        .drop(at, last, "_lag", "_head", carried)
    )


def with_running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column | dict[str, Column],
    chunk: Column | list[Column],
    name: str = "",
) -> DataFrame:
    """Add ``name``: the sum of ``value`` from the first row of the key up to this one.

    Several sums share one pass as ``{name: value}``. ``chunk`` may be several columns from fine to
    coarse: the totals of the fine chunks are then summed up in coarser chunks, and so on, so that no task
    gets all of them.
    """
    values = value if isinstance(value, dict) else {name: value}
    fine, *coarser = chunk if isinstance(chunk, list) else [chunk]
    level = len(coarser)
    at = f"_chunk{level}"
    cut = [*keys, at]
    part = {n: f"_part{level}_{n}" for n in values}
    total = {n: f"_total{level}_{n}" for n in values}
    offset = {n: f"_offset{level}_{n}" for n in values}
    rows = df.withColumns({part[n]: c for n, c in values.items()}).withColumn(at, fine)
    above = {f"_above{i}": c for i, c in enumerate(coarser)}
    totals = (
        rows.withColumns(above)
        .groupBy(*cut)
        .agg(*(F.sum(part[n]).alias(total[n]) for n in values), *(F.max(a).alias(a) for a in above))
    )
    upto = {f"_upto{level}_{n}": F.col(total[n]) for n in values}
    if coarser:
        totals = with_running_sum(totals, keys, at, upto, [F.col(a) for a in above])
    else:
        along = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        totals = totals.withColumns({n: F.sum(c).over(along) for n, c in upto.items()})
    offsets = totals.select(
        *[F.col(c).alias(f"_of_{c}") for c in cut],
        *[(F.col(f"_upto{level}_{n}") - F.col(total[n])).alias(offset[n]) for n in values],
    )
    inside = Window.partitionBy(*cut).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cut])
    return (
        rows.withColumns({n: F.sum(part[n]).over(inside) for n in values})
        .join(offsets, same, "left")
        .withColumns({n: F.col(n) + F.col(offset[n]) for n in values})
        .drop(at, *part.values(), *offset.values(), *(f"_of_{c}" for c in cut))
    )


def islands(
    df: DataFrame, keys: list[str], order: str, status: str, chunk: Column
) -> DataFrame:
    """Unbroken stretches of equal ``status`` per key: first and last ``order``, row count."""
    seen = with_previous(df, keys, order, F.col(status), chunk, "_previous")
    starts = (~F.col(status).eqNullSafe(F.col("_previous"))).cast("int")
    numbered = with_running_sum(seen, keys, order, starts, chunk, "_island")
    return (
        numbered.groupBy(*keys, status, "_island")
        .agg(
            F.min(order).alias("streak_start"),
            F.max(order).alias("streak_end"),
            F.count(F.lit(1)).alias("runs"),
        )
        .drop("_island")
    )
