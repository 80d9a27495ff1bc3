"""Competing definitions of monthly revenue, side by side and explained.

Each definition is a set of choices. All of them are answered by one pass over the
orders and one over the refunds, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions.periods import period_span
from martwright.functions.values import exact_decimal, within


@dataclass(frozen=True)
class Definition:
    name: str
    status: str = "completed"
    any_other_status: bool = False  # every status but ``status``
    rolling_days: int | None = None  # instead of the calendar month
    local_fallback: bool = False  # local amount where the converted one is missing
    settled_only: bool = False  # invoiced and paid
    net: bool = True  # refunds subtracted
    digits: int | None = None


ENGINEERING = Definition(
    "engineering", status="cancelled", any_other_status=True, local_fallback=True, net=False
)
ANALYTICS = Definition("analytics", rolling_days=30, local_fallback=True)
FINANCE = Definition("finance", settled_only=True)
ALIGNED = Definition("aligned", digits=2)
DEFINITIONS = (ENGINEERING, ANALYTICS, FINANCE, ALIGNED)

# The choices in the order in which a difference is attributed to them.
CHOICES = ("status", "period", "currency", "settlement")
# The choices between which a difference is split evenly; refunds change the amount, not the orders.
SWITCHES = (*CHOICES, "refunds")


def _span(definition: Definition, month: date, as_of: date) -> tuple[date | None, date | None]:
    if definition.rolling_days is not None:
        return as_of - timedelta(days=definition.rolling_days), None
    return period_span(month, "month")


def _conditions(
    orders: DataFrame, definition: Definition, month: date, as_of: date
) -> dict[str, Column]:
    """One condition per choice; a NULL comparison does not qualify."""
    status = F.col("status")
    tests = {
        "status": status != definition.status
        if definition.any_other_status
        else status == definition.status,
        "period": within(orders, "order_date", *_span(definition, month, as_of)),
        "currency": F.lit(True) if definition.local_fallback else F.col("amount").isNotNull(),
        "settlement": F.col("invoiced_at").isNotNull() & F.col("paid_at").isNotNull()
        if definition.settled_only
        else F.lit(True),
    }
    return {choice: F.coalesce(test, F.lit(False)) for choice, test in tests.items()}


def _all_met(conditions: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions.values())


def _any_met(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _first_failed(conditions: dict[str, Column]) -> Column:
    reason = F.lit(None).cast("string")
    for choice in reversed(CHOICES):
        reason = F.when(~conditions[choice], choice).otherwise(reason)
    return reason


def _gross(definition: Definition) -> Column:
    if definition.local_fallback:
        return F.coalesce("amount", "amount_local")
    return F.col("amount")


def _in_scope(
    orders: DataFrame, definitions: tuple[Definition, ...], month: date, as_of: date
) -> DataFrame:
    """Orders in the span of at least one definition: a filter the scan can use."""
    starts, ends = zip(*(_span(d, month, as_of) for d in definitions), strict=True)
    start = min(starts)
    end = None if None in ends else max(ends)
    return orders.filter(within(orders, "order_date", start, end))


def _refund_per_order(refunds: DataFrame) -> DataFrame:
    """Refunds combined per order first: an order with very many refunds is one row."""
    return refunds.groupBy("order_id").agg(
        exact_decimal(refunds, "refund_amount").alias("refund")
    )


def definition_values(
    orders: DataFrame,
    refunds: DataFrame,
    definitions: tuple[Definition, ...],
    month: date,
    as_of: date,
) -> DataFrame:
    """One row with one column per definition; NULL when no order qualifies."""
    scope = _in_scope(orders, definitions, month, as_of)
    counts = {d: _all_met(_conditions(scope, d, month, as_of)) for d in definitions}
    flagged = scope.filter(_any_met(counts.values())).select(
        "order_id",
        *[F.when(inside, _gross(d)).alias(d.name) for d, inside in counts.items()],
        *[inside.alias(f"in_{d.name}") for d, inside in counts.items()],
    )
    if any(d.net for d in definitions):
        # Only refunds of these orders are grouped; few orders are broadcast by their size.
        theirs = refunds.join(flagged.select("order_id"), "order_id", "left_semi")
        flagged = flagged.join(_refund_per_order(theirs), "order_id", "left")
    totals = []
    for d in definitions:
        total = F.sum(d.name)
        if d.net:
            refunded = F.sum(F.when(F.col(f"in_{d.name}"), F.col("refund")))
            total = total - F.coalesce(refunded, F.lit(0))
        if d.digits is not None:
            total = F.round(total, d.digits)
        totals.append(total.cast("double").alias(d.name))
    return flagged.agg(*totals)


def monthly_revenue(
    orders: DataFrame, refunds: DataFrame, definition: Definition, month: date, as_of: date
) -> DataFrame:
    """The value of one definition."""
    values = definition_values(orders, refunds, (definition,), month, as_of)
    return values.withColumnRenamed(definition.name, "monthly_revenue")


def definition_compare(
    orders: DataFrame,
    refunds: DataFrame,
    month: date,
    as_of: date,
    definitions: tuple[Definition, ...] = DEFINITIONS,
    reference: Definition = ALIGNED,
) -> DataFrame:
    """One row per definition with its difference to the reference definition."""
    values = definition_values(orders, refunds, definitions, month, as_of)
    rows = F.array(
        *[
            F.struct(
                F.lit(d.name).alias("definition"),
                F.col(d.name).alias("monthly_revenue"),
                (F.col(d.name) - F.col(reference.name)).alias(f"delta_to_{reference.name}"),
            )
            for d in definitions
        ]
    )
    return values.select(F.inline(rows))


def definition_gap(
    orders: DataFrame,
    refunds: DataFrame,
    month: date,
    as_of: date,
    definitions: tuple[Definition, ...] = (ENGINEERING, ANALYTICS, FINANCE),
    reference: Definition = ALIGNED,
) -> DataFrame:
    """Which choice explains the difference of each definition to the reference.

    The amounts of one definition add up to its difference.
    """
    scope = _in_scope(orders, (*definitions, reference), month, as_of)
    base = _conditions(scope, reference, month, as_of)
    in_base = _all_met(base)
    refund = F.coalesce("refund", F.lit(0))

    def part(d: Definition, inside: Column) -> Column:
        value = F.coalesce(_gross(d), F.lit(0))
        return F.when(inside, value - refund if d.net else value).otherwise(F.lit(0))

    entries, counted = [], [in_base]
    for d in definitions:
        tests = _conditions(scope, d, month, as_of)
        inside = _all_met(tests)
        counted.append(inside)
        reason = (
            F.when(inside & ~in_base, _first_failed(base))
            .when(in_base & ~inside, _first_failed(tests))
            .when(inside & in_base & F.lit(d.net != reference.net) & (refund != 0), "refunds")
        )
        entries.append(
            F.struct(
                F.lit(d.name).alias("definition"),
                reason.alias("reason"),
                (part(d, inside) - part(reference, in_base)).alias("delta"),
            )
        )
    return (
        scope.filter(_any_met(counted))
        .join(_refund_per_order(refunds), "order_id", "left")
        .select(F.inline(F.array(*entries)))
        .filter(F.col("reason").isNotNull())
        .groupBy("definition", "reason")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("delta").cast("double").alias("delta"),
        )
    )


def definition_hybrids(
    orders: DataFrame,
    refunds: DataFrame,
    month: date,
    as_of: date,
    definitions: tuple[Definition, ...] = (ENGINEERING, ANALYTICS, FINANCE),
    reference: Definition = ALIGNED,
    switches: tuple[str, ...] = SWITCHES,
) -> DataFrame:
    """Value of the reference with any of its choices replaced by those of a definition.

    (definition, taken, value): bit i of ``taken`` says that choice i of ``switches`` is the
    definition's. 0 is the reference itself and the greatest number the definition, both without
    rounding; no order that qualifies gives 0. Orders are summed per combination of met conditions first,
    at most 256 per definition, so that the combinations of choices are made of these few sums.
    """
    if sorted(switches) != sorted(SWITCHES):
        raise ValueError(f"switches are an order of {', '.join(SWITCHES)}")
    scope = _in_scope(orders, (*definitions, reference), month, as_of)
    base = _conditions(scope, reference, month, as_of)
    entries, reachable = [], []
    for d in definitions:
        own = _conditions(scope, d, month, as_of)
        reachable.append(_all_met({c: own[c] | base[c] for c in CHOICES}))
        entries.append(
            F.when(
                reachable[-1],
                F.struct(
                    F.lit(d.name).alias("definition"),
                    *[own[c].alias(f"own_{c}") for c in CHOICES],
                    *[base[c].alias(f"base_{c}") for c in CHOICES],
                    F.coalesce(_gross(d), F.lit(0)).alias("own_gross"),
                    F.coalesce(_gross(reference), F.lit(0)).alias("base_gross"),
                    F.coalesce("refund", F.lit(0)).alias("refund"),
                ),
            )
        )
    flags = [f"{side}_{c}" for c in CHOICES for side in ("own", "base")]
    sums = (
        scope.filter(_any_met(reachable))
        .join(_refund_per_order(refunds), "order_id", "left")
        .select(F.inline(F.array_compact(F.array(*entries))))
        .groupBy("definition", *flags)
        .agg(*[F.sum(c).alias(c) for c in ("own_gross", "base_gross", "refund")])
    )

    def own(switch: str) -> Column:
        return F.col("taken").bitwiseAND(1 << switches.index(switch)) != 0

    counted = reduce(
        lambda a, b: a & b,
        [F.when(own(c), F.col(f"own_{c}")).otherwise(F.col(f"base_{c}")) for c in CHOICES],
    )
    net = F.lit(False)
    for d in definitions:
        theirs = F.when(own("refunds"), F.lit(d.net)).otherwise(F.lit(reference.net))
        net = F.when(F.col("definition") == d.name, theirs).otherwise(net)
    gross = F.when(own("currency"), F.col("own_gross")).otherwise(F.col("base_gross"))
    value = F.when(counted, gross - F.when(net, F.col("refund")).otherwise(F.lit(0)))
    return (
        sums.withColumn("taken", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(switches) - 1))))
        .groupBy("definition", "taken")
        .agg(F.coalesce(F.sum(value), F.lit(0)).alias("value"))
    )


def definition_shares(
    orders: DataFrame,
    refunds: DataFrame,
    month: date,
    as_of: date,
    definitions: tuple[Definition, ...] = (ENGINEERING, ANALYTICS, FINANCE),
    reference: Definition = ALIGNED,
    switches: tuple[str, ...] = SWITCHES,
) -> DataFrame:
    """The part of each choice in the difference of a definition to the reference.

    (definition, choice, delta): what taking over the choice changes, on average over all orders in which
    the choices can be taken over. The parts of a definition add up to its difference, and the
    order of ``switches`` does not matter. Weights are whole numbers over n!, so the sums are exact.
    """
    hybrids = definition_hybrids(orders, refunds, month, as_of, definitions, reference, switches)
    n = len(switches)
    taken = F.bit_count("taken")
    # Of the n! orders, those in which exactly the other choices of ``taken`` come before this one.
    with_it = F.lit(None).cast("int")
    without = F.lit(None).cast("int")
    for size in range(n + 1):
        if size:
            with_it = F.when(taken == size, factorial(size - 1) * factorial(n - size)).otherwise(with_it)
        if size < n:
            without = F.when(taken == size, factorial(size) * factorial(n - size - 1)).otherwise(without)
    parts = [
        F.sum(
            F.when(F.col("taken").bitwiseAND(1 << i) != 0, with_it).otherwise(-without)
            * F.col("value")
        ).alias(switch)
        for i, switch in enumerate(switches)
    ]
    entries = [
        F.struct(
            F.lit(switch).alias("choice"),
            (F.col(switch).cast("double") / F.lit(float(factorial(n)))).alias("delta"),
        )
        for switch in switches
    ]
    return hybrids.groupBy("definition").agg(*parts).select("definition", F.inline(F.array(*entries)))


def membership(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of two row sets: each key with where it occurs."""
    one = left.select(*keys).distinct().withColumn("_l", F.lit(True))
    two = right.select(*keys).distinct().withColumn("_r", F.lit(True))
    return one.join(two, keys, "full_outer").select(
        *keys,
        F.when(F.col("_r").isNull(), "left only")
        .when(F.col("_l").isNull(), "right only")
        .otherwise("both")
        .alias("side"),
    )


def qualifying(orders: DataFrame, definition: Definition, month: date, as_of: date) -> DataFrame:
    """The orders one definition counts."""
    return orders.filter(_all_met(_conditions(orders, definition, month, as_of)))
