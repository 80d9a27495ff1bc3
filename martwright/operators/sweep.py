"""Subscriptions over time: how many run, and what they bring in, on every day of a range.

A subscription runs over ``[started_at, ended_at)``. It is a step up on its first day and a step down on the day
it ends; both are summed per day (and plan) and then added up along the days. No row meets the
calendar, so the work grows with the subscriptions and not with the days that they run. Steps of a plan and day are
summed in the map tasks before they are shuffled; the days are added up in chunks of a month.

Defined results: a missing start never runs; an end at or before the start never runs; a missing end runs on; a
missing plan is a plan of its own; every plan that has a subscription has all days; amounts
are exact to ``digits`` decimal places.
"""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.functions.ordered import with_running_sum
from martwright.functions.values import day_literal, month_of, percent
from martwright.operators.metrics import BILLING_INTERVALS, PAYING_STATUSES, UNPAID_PLANS


def _paying(annual_is_monthly_equiv: bool) -> tuple[Column, Column]:
    """Whether a subscription brings in revenue, and whether it is billed by the year."""
    pays = (
        F.col("status").isin(*PAYING_STATUSES)
        & ~F.lower("plan_name").isin(*UNPAID_PLANS)
        & F.col("billing_interval").isin(*BILLING_INTERVALS)
    )
    yearly = F.lit(False) if annual_is_monthly_equiv else F.col("billing_interval") == "annual"
    return F.coalesce(pays, F.lit(False)), yearly


def _steps(rows: DataFrame, up: Column, down: Column, last: date, values: dict[str, Column]) -> DataFrame:
    """(plan, day, values): each row's values at ``up``, and less them at ``down`` if that is in the range."""
    ends = F.when(down <= day_literal(last), down)
    signed = [
        F.struct(at.alias("day"), F.lit(sign).alias("sign")) for at, sign in ((up, 1), (ends, -1))
    ]
    return (
        rows.select("plan", *[c.alias(n) for n, c in values.items()], F.explode(F.array(*signed)).alias("step"))
        .where("step.day is not null")
        .groupBy("plan", F.col("step.day").alias("day"))
        .agg(*[F.sum(F.when(F.col("step.sign") > 0, F.col(n)).otherwise(-F.col(n))).alias(n) for n in values])
    )


def active_by_day(
    subscriptions: DataFrame,
    first: date,
    last: date,
    *,
    by_plan: bool = True,
    digits: int = 2,
    annual_is_monthly_equiv: bool = False,
) -> DataFrame:
    """(plan, day, active, mrr) for every day from ``first`` to ``last``.

    ``active`` counts all running subscriptions, ``mrr`` adds up those that ``metrics.recurring_revenue``
    counts; annual charges are divided by 12 last.
    """
    pays, yearly = _paying(annual_is_monthly_equiv)
    charge = F.when(pays, F.col("plan_amount")).cast(f"decimal(20,{digits})")
    charge = F.coalesce(charge, F.lit(Decimal(0).scaleb(-digits)))
    zero = F.lit(Decimal(0).scaleb(-digits))
    began, ended = F.col("started_at").cast("date"), F.col("ended_at").cast("date")
    plan = F.col("plan_name") if by_plan else F.lit("all")
    rows = subscriptions.withColumn("plan", plan).where(
        began.isNotNull() & (ended.isNull() | (ended > began))
    )
    start = day_literal(first)
    running = rows.where((began <= day_literal(last)) & (ended.isNull() | (ended > start)))
    values = {
        "active": F.lit(1).cast("long"),
        "monthly": F.when(~yearly, charge).otherwise(zero),
        "annual": F.when(yearly, charge).otherwise(zero),
    }
    steps = _steps(running, F.greatest(began, start), ended, last, values)
    days = rows.select("plan").distinct().select(
        "plan", F.explode(F.sequence(start, day_literal(last))).alias("day")
    )
    daily = (
        steps.unionByName(days, allowMissingColumns=True)
        .groupBy("plan", "day")
        .agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in values])
    )
    sums = with_running_sum(
        daily,
        ["plan"],
        "day",
        {f"{n}_now": F.col(n) for n in values},
        [month_of("day"), F.trunc("day", "year")],
    )
    return sums.select(
        *(["plan"] if by_plan else []),
        "day",
        F.col("active_now").alias("active"),
        (F.col("monthly_now").cast("double") + F.col("annual_now").cast("double") / 12).alias("mrr"),
    )


def churn_by_month(subscriptions: DataFrame, first: date, last: date) -> DataFrame:
    """``metrics.churn_rate`` for every month from ``first`` to ``last`` (firsts of months).

    A subscription is active at the starts of the months after its start up to its end; it churns in the
    month after whose first day it ends.
    """
    paid = F.coalesce(~F.lower("plan_name").isin(*UNPAID_PLANS) & (F.col("status") != "trialing"), F.lit(False))
    began, ended = F.col("started_at").cast("date"), F.col("ended_at").cast("date")
    following = lambda day: F.add_months(F.trunc(day, "month"), 1)
    up = F.greatest(following(began), day_literal(first))
    down = F.when(F.trunc(ended, "month") == ended, ended).otherwise(following(ended))
    rows = subscriptions.withColumn("plan", F.lit("all")).where(
        paid & began.isNotNull() & (following(began) <= day_literal(last)) & (ended.isNull() | (down > up))
    )
    steps = _steps(rows, up, down, last, {"active": F.lit(1).cast("long")})
    # the step down of a churn stands on the month after it
    gone_in = F.add_months(down, -1)
    churned = (
        rows.where((F.trunc(ended, "month") != ended) & (gone_in <= day_literal(last)))
        .groupBy(F.lit("all").alias("plan"), gone_in.alias("day"))
        .agg(F.count(F.lit(1)).alias("churned"))
    )
    months = subscriptions.sparkSession.range(1).select(
        F.lit("all").alias("plan"),
        F.explode(F.expr(f"sequence(DATE'{first}', DATE'{last}', INTERVAL 1 MONTH)")).alias("day"),
    )
    monthly = (
        steps.unionByName(churned, allowMissingColumns=True)
        .unionByName(months, allowMissingColumns=True)
        .groupBy("plan", "day")
        .agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("active", "churned")])
    )
    sums = with_running_sum(monthly, ["plan"], "day", F.col("active"), F.trunc("day", "year"), "active_at_start")
    return sums.select(
        F.col("day").alias("month"),
        "active_at_start",
        "churned",
        percent(F.col("churned"), F.col("active_at_start")).alias("churn_pct"),
    )
