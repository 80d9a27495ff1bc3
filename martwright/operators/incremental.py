"""Marts kept up to date from changes instead of being built anew.

A mart is a set of groups with counts, sums, minima and maxima over the rows of a base table. Its
stored state holds one row per group, cut into folders by a hash of the group. A change set
(rows with ``_sign`` 1 for a row put in and -1 for a row taken out, see ``sources/load.py``) is
summed up per group, and these partial aggregates are merged into the folders of the groups that they
touch; nothing else is read or written.

Counts and sums take retractions as they are. A maximum (or minimum) does so unless the row taken
out may have been the largest and no row put in is as large: only such groups are looked up in the
base table.

Every group carries the number of the last batch merged into it and stays, without rows, when its last row goes.
A batch that is applied again after a failure therefore counts once in each group. Batches are applied in
the order of their numbers; a change set holds at most one change into and one out of a row.

Defined results: missing values form a group of their own and count in no measure; empty change sets
leave the state as it is; sums are exact decimals, so the order of batches does not show in a mart.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.functions.values import instant
from martwright.session import cut_lineage
from martwright.sources.load import BUCKET, SIGN, bucket_of, existing

ROWS, BATCH = "_rows", "_batch"
_DECIMAL = "decimal(38,{})"


@dataclass(frozen=True)
class Measure:
    """``count``, ``sum``, ``min`` or ``max`` of an SQL expression over a base row.

    ``digits`` are the decimal places of a sum.
    """

    name: str
    kind: str
    value: str
    digits: int = 2

    def __post_init__(self) -> None:
        if self.kind not in ("count", "sum", "min", "max"):
            raise ValueError(f"unknown kind of measure '{self.kind}'")

    @property
    def ordered(self) -> bool:
        return self.kind in ("min", "max")

    def of_row(self) -> Column:
        value = F.expr(self.value)
        return value.cast(_DECIMAL.format(self.digits)) if self.kind == "sum" else value


@dataclass(frozen=True)
class Mart:
    """Groups (name to SQL expression) and measures over the base rows where ``where`` holds."""

    keys: dict[str, str]
    measures: tuple[Measure, ...]
    where: str = "true"

    def rows(self, base: DataFrame, *more: str) -> DataFrame:
        return base.where(self.where).select(
            *[F.expr(e).alias(k) for k, e in self.keys.items()],
            *[m.of_row().alias(m.name) for m in self.measures],
            *more,
        )


# Fixed shapes: the two marts of ``operators/marts.py``.
def daily_revenue_mart(paid: str = "paid") -> Mart:
    return Mart(
        {"day": "cast(order_at as date)"},
        (Measure("revenue", "sum", "amount"),),
        f"status = '{paid}'",
    )


def customer_ltv_mart(paid: str = "paid") -> Mart:
    return Mart(
        {"customer_id": "customer_id"},
        (
            Measure("lifetime_orders", "count", "order_id"),
            Measure("paid", "sum", f"case when status = '{paid}' then amount end"),
            Measure("last_order_at", "max", "order_at"),
        ),
    )


def delta(changes: DataFrame, mart: Mart) -> DataFrame:
    """Partial aggregates of a change set: a row per touched group.

    Of an ordered measure the extreme of the rows put in stands under its name, that of the
    rows taken out under ``<name>_out``.
    """
    put_in = F.col(SIGN) > 0
    out = [F.sum(F.col(SIGN).cast("long")).alias(ROWS)]
    for m in mart.measures:
        value = F.col(m.name)
        if m.kind == "count":
            out.append(F.sum(F.when(value.isNotNull(), F.col(SIGN).cast("long")).otherwise(0)).alias(m.name))
        elif m.kind == "sum":
            out.append(_summed(F.when(put_in, value).otherwise(-value), m))
        else:
            extreme = F.max if m.kind == "max" else F.min
            out.append(extreme(F.when(put_in, value)).alias(m.name))
            out.append(extreme(F.when(~put_in, value)).alias(f"{m.name}_out"))
    return mart.rows(changes, SIGN).groupBy(*mart.keys).agg(*out)


def _summed(value: Column, m: Measure) -> Column:
    return F.coalesce(F.sum(value), F.lit(0)).cast(_DECIMAL.format(m.digits)).alias(m.name)


def merged(state: DataFrame, part: DataFrame, mart: Mart, batch: int) -> DataFrame:
    """State after a batch; ``_stale_<name>`` marks groups whose extreme may be gone.

    One shuffle by folder; a group that has the batch already stays as it is.
    """
    ordered = [m for m in mart.measures if m.ordered]
    held = state.withColumns(
        {"_part": F.lit(0), **{f"{m.name}_out": F.lit(None).cast(state.schema[m.name].dataType) for m in ordered}}
    )
    rows = held.unionByName(part.withColumns({"_part": F.lit(1), BATCH: F.lit(batch).cast("long")}))
    old, new = F.col("_part") == 0, F.col("_part") == 1

    def both(name: str) -> list[Column]:
        return [F.max(F.when(s, F.col(name))).alias(f"{name}{i}") for i, s in enumerate((old, new))]

    names = [ROWS, *(m.name for m in mart.measures), BATCH]
    sides = rows.repartition(BUCKET).groupBy(BUCKET, *mart.keys).agg(
        *[c for n in names for c in both(n)],
        *[F.max(F.when(new, F.col(f"{m.name}_out"))).alias(f"{m.name}_out") for m in ordered],
    )
    applies = F.coalesce(F.col(f"{BATCH}0"), F.lit(-1)) < F.lit(batch)

    def added(name: str) -> Column:
        before = F.coalesce(F.col(f"{name}0"), F.lit(0))
        return F.when(applies, before + F.coalesce(F.col(f"{name}1"), F.lit(0))).otherwise(before)

    out = [F.col(BUCKET), *mart.keys, added(ROWS).alias(ROWS)]
    stale = []
    for m in mart.measures:
        before, comes, gone = F.col(f"{m.name}0"), F.col(f"{m.name}1"), F.col(f"{m.name}_out")
        if not m.ordered:
            out.append(added(m.name).cast(state.schema[m.name].dataType).alias(m.name))
            continue
        extreme = F.greatest if m.kind == "max" else F.least
        out.append(F.when(applies, extreme(before, comes)).otherwise(before).alias(m.name))
        lost = gone >= before if m.kind == "max" else gone <= before
        refilled = comes >= before if m.kind == "max" else comes <= before
        mark = applies & F.coalesce(lost, F.lit(False)) & ~F.coalesce(refilled, F.lit(False))
        stale.append(mark.alias(f"_stale_{m.name}"))
    out.append(F.when(applies, F.lit(batch).cast("long")).otherwise(F.col(f"{BATCH}0")).alias(BATCH))
    return sides.select(*out, *stale)


def looked_up(state: DataFrame, base: DataFrame, mart: Mart) -> DataFrame:
    """The state with its stale extremes taken from the base table's rows of those groups."""
    ordered = [m for m in mart.measures if m.ordered]
    marks = [f"_stale_{m.name}" for m in ordered]
    any_mark = reduce(lambda a, b: a | b, [F.col(x) for x in marks])
    keys = [F.col(k).alias(f"_of_{k}") for k in mart.keys]
    wanted = cut_lineage(state.filter(any_mark).select(*keys))
    if wanted.isEmpty():
        return state.drop(*marks)
    same = _null_safe(mart.keys, "_of_")
    found = (
        mart.rows(base)
        .join(wanted, same, "left_semi")
        .groupBy(*keys)
        .agg(*[(F.max if m.kind == "max" else F.min)(m.name).alias(f"_now_{m.name}") for m in ordered])
    )
    joined = state.join(found, same, "left")
    fresh = {m.name: F.when(F.col(f"_stale_{m.name}"), F.col(f"_now_{m.name}")).otherwise(F.col(m.name)) for m in ordered}
    return joined.withColumns(fresh).select(*[c for c in state.columns if c not in marks])


def _null_safe(keys, prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def refresh(
    path: str,
    mart: Mart,
    changes: DataFrame,
    batch: int,
    base: Callable[[], DataFrame],
    buckets: int = 64,
) -> int:
    """Merge a change set into the mart state at ``path``; returns the number of folders written.

    ``base()`` opens the base table as it is after the batch. The folder numbers of the touched groups
    (``buckets`` at most) are all that reaches the driver.
    """
    spark = changes.sparkSession
    part = cut_lineage(delta(changes, mart).withColumn(BUCKET, bucket_of(list(mart.keys), buckets)))
    touched = [r[0] for r in part.select(BUCKET).distinct().collect()]
    if not touched:
        return 0
    home = _home(path, buckets)
    stored = existing(spark, home)
    if stored is None:
        names = [BUCKET, *mart.keys, ROWS, *(m.name for m in mart.measures)]
        stored = part.select(*names).withColumn(BATCH, F.lit(0).cast("long")).limit(0)
    state = merged(stored.filter(F.col(BUCKET).isin(touched)), part, mart, batch)
    if any(m.ordered for m in mart.measures):
        state = looked_up(cut_lineage(state), base(), mart).repartition(BUCKET)
    (
        state.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET)
        .parquet(home)
    )
    return len(touched)


def _home(path: str, buckets: int) -> str:
    return f"{path}/buckets={buckets}"


def mart_rows(spark: SparkSession, path: str, mart: Mart, buckets: int = 64) -> DataFrame:
    """The groups that have rows, with their measures and ``_rows``."""
    state = spark.read.parquet(_home(path, buckets))
    return state.filter(F.col(ROWS) > 0).select(*mart.keys, ROWS, *(m.name for m in mart.measures))


def as_daily_revenue(rows: DataFrame, as_of: datetime) -> DataFrame:
    """The stored state in the shape of ``marts.daily_revenue``."""
    return rows.select(
        "day",
        F.col(ROWS).alias("order_count"),
        F.col("revenue").cast("double").alias("revenue"),
        instant(as_of).alias("updated_at"),
    )


def as_customer_ltv(rows: DataFrame, customers: DataFrame, as_of: datetime) -> DataFrame:
    """The stored state in the shape of ``marts.customer_ltv``."""
    return customers.join(rows, "customer_id", "left").select(
        "customer_id",
        "name",
        "country",
        F.coalesce("lifetime_orders", F.lit(0)).alias("lifetime_orders"),
        F.coalesce(F.col("paid").cast("double"), F.lit(0.0)).alias("lifetime_revenue"),
        "last_order_at",
        instant(as_of).alias("updated_at"),
    )
