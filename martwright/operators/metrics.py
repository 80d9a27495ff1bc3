"""Business metrics over orders, events, subscriptions and tickets."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.functions.percentiles import exact_percentile
from martwright.functions.periods import period_span
from martwright.functions.skew import salted_join
from martwright.functions.values import (
    day_literal,
    exact_decimal,
    month_of,
    percent,
    ratio,
    rounded,
    total,
    whole,
    within,
)


def average_order_value(orders: DataFrame, completed: str = "completed") -> DataFrame:
    """Per month: revenue of completed orders with a positive amount over their number."""
    return (
        orders.filter((F.col("status") == completed) & (F.col("amount") > 0))
        .groupBy(month_of("order_at").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("orders"),
            rounded(ratio(total(orders, "amount"), F.count(F.lit(1))), 2).alias("aov"),
        )
    )


def merchandise_revenue(
    orders: DataFrame,
    invoices: DataFrame,
    completed: str = "completed",
    finalized: str = "finalized",
    digits: int | None = None,
) -> DataFrame:
    """Per month: net amount plus tax of finalized invoices of completed orders.

    Invoices are summed per order before the join: one row per order whatever the
    number of its invoices. Amounts arrive in the base currency; ``digits`` states the
    decimal places of net amount plus tax, if they have any such bound.
    """
    billed = invoices.filter(F.col("invoice_status") == finalized).withColumn(
        "gross", F.col("net_amount") + F.col("tax")
    )
    per_order = billed.groupBy("order_id").agg(exact_decimal(billed, "gross", digits).alias("gross"))
    return (
        orders.filter(F.col("status") == completed)
        .select("order_id", month_of("order_at").alias("month"))
        .join(per_order, "order_id")
        .groupBy("month")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("gross").cast("double").alias("gmv"),
        )
    )


def first_order(orders: DataFrame, owner: str = "customer_id") -> DataFrame:
    """The earliest order of each owner; equal times go to the lower order id."""
    earliest = F.min(F.struct("order_at", "order_id", "status", "amount")).alias("_first")
    return orders.groupBy(owner).agg(earliest).select(owner, "_first.*")


def order_conversion(
    sessions: DataFrame, orders: DataFrame, session: str, completed: str = "completed"
) -> DataFrame:
    """Percent of sessions whose first order is completed."""
    won = (
        first_order(orders, session)
        .filter(F.col("status") == completed)
        .select(session, F.lit(1).alias("_won"))
    )
    return _matched_share(sessions.select(session).distinct(), won, session, "conversion_pct")


def _matched_share(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Both sides hold each key once; ``right`` carries one flag column."""
    flag = next(c for c in right.columns if c != key)
    return left.join(right, key, "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count(flag).alias("matched"),
        rounded(percent(F.count(flag), F.count(F.lit(1))), 2).alias(name),
    )


def daily_active_users(events: DataFrame, active_types: list[str]) -> DataFrame:
    """Distinct users per day over the listed event types."""
    return (
        events.filter(F.col("event_type").isin(active_types) & F.col("user_id").isNotNull())
        .groupBy(F.col("ts").cast("date").alias("day"))
        .agg(F.count_distinct("user_id").alias("dau"))
    )


def signups_on(events: DataFrame, day: date, signup: str = "signup") -> DataFrame:
    """Distinct users with a signup event on the day."""
    start, end = period_span(day, "day")
    return (
        events.filter(
            (F.col("event_type") == signup)
            & within(events, "ts", start, end)
            & F.col("user_id").isNotNull()
        )
        .agg(F.count_distinct("user_id").alias("signups"))
        .select(day_literal(day).alias("day"), "signups")
    )


def conversion_rate(visits: DataFrame, conversions: DataFrame, key: str) -> DataFrame:
    """Percent of distinct visits with a conversion.

    Both sides are reduced to distinct keys first, so a very frequent key is one row
    in the join, and the join reuses the partitioning of the two reductions.
    """
    won = conversions.select(key).distinct().withColumn("_won", F.lit(1))
    return _matched_share(visits.select(key).distinct(), won, key, "conversion_pct")


def converted(visits: DataFrame, conversions: DataFrame, key: str) -> DataFrame:
    """The distinct visits that have a conversion."""
    return visits.select(key).distinct().join(
        conversions.select(key).distinct(), key, "left_semi"
    )


def abandoned(carts: DataFrame, checkouts: DataFrame, key: str | list[str]) -> DataFrame:
    """The distinct carts without a checkout."""
    keys = [key] if isinstance(key, str) else key
    return carts.select(*keys).distinct().join(
        checkouts.select(*keys).distinct(), keys, "left_anti"
    )


def cart_abandonment(
    carts: DataFrame, checkouts: DataFrame, as_of: datetime, key: str = "cart_id", hours: int = 24
) -> DataFrame:
    """Percent of the carts of the last hours, with at least one item, that have no checkout."""
    recent = carts.filter(
        within(carts, "created_at", as_of - timedelta(hours=hours), as_of) & (F.col("items") >= 1)
    )
    paid = checkouts.select(key).distinct().withColumn("_paid", F.lit(1))
    share = _matched_share(recent.select(key).distinct(), paid, key, "checkout_pct")
    return share.select(
        F.col("total").alias("carts"),
        (F.col("total") - F.col("matched")).alias("abandoned"),
        percent(F.col("total") - F.col("matched"), F.col("total")).alias("abandonment_pct"),
    )


# What counts as recurring revenue.
PAYING_STATUSES = ("active", "past_due")
UNPAID_PLANS = ("free", "trial")
BILLING_INTERVALS = ("monthly", "annual")


def recurring_revenue(
    subscriptions: DataFrame, annual_is_monthly_equiv: bool = False, by_plan: bool = True
) -> DataFrame:
    """Monthly recurring revenue per plan or in total; annual charges count a twelfth.

    Monthly and annual charges are summed apart and divided last.
    """
    paying = subscriptions.filter(
        F.col("status").isin(*PAYING_STATUSES)
        & ~F.lower("plan_name").isin(*UNPAID_PLANS)
        & F.col("billing_interval").isin(*BILLING_INTERVALS)
    )
    yearly = F.col("billing_interval") == "annual"
    months = 1 if annual_is_monthly_equiv else 12
    annual = F.coalesce(total(paying, "plan_amount", yearly), F.lit(0.0))
    monthly = F.coalesce(total(paying, "plan_amount", ~yearly), F.lit(0.0))
    plans = [F.col("plan_name").alias("plan")] if by_plan else []
    return paying.groupBy(*plans).agg(
        F.count(F.lit(1)).alias("subscriptions"),
        (monthly + annual / months).alias("mrr"),
    )


def churn_rate(
    subscriptions: DataFrame,
    month: date,
    min_cycle_months: int = 0,
) -> DataFrame:
    """Percent of the paid subscriptions active at the start of the month that end in it.

    ``ended_at`` is the cancellation, or the end of the paid period of an expired one;
    a subscription runs over ``[started_at, ended_at)``.
    """
    start, end = period_span(month, "month")
    first, last = day_literal(start), day_literal(end)
    began = F.col("started_at").cast("date")
    ended = F.col("ended_at").cast("date")
    oldest = F.add_months(first, -min_cycle_months)
    paid = ~F.lower("plan_name").isin(*UNPAID_PLANS) & (F.col("status") != "trialing")
    before = began <= oldest if min_cycle_months else began < first
    active = paid & before & (ended.isNull() | (ended > first))
    return subscriptions.agg(
        F.count_if(active).alias("active_at_start"),
        F.count_if(active & (ended < last)).alias("churned"),
    ).select(
        first.alias("month"),
        "active_at_start",
        "churned",
        percent(F.col("churned"), F.col("active_at_start")).alias("churn_pct"),
    )


def ended_at(status: Column, canceled_at: Column, period_end: Column) -> Column:
    """When a subscription stopped: its cancellation, else the period end once expired."""
    return F.coalesce(canceled_at, F.when(status == "expired", period_end))


def revenue_retention(
    revenue: DataFrame, month: date, months_back: int = 12, customer: str = "customer_id"
) -> DataFrame:
    """Net revenue retention of the customers who paid ``months_back`` months ago.

    The cohort is compared with itself by one aggregation per customer, not by a
    self-join. Movements are split into expansion, contraction and churn.
    """
    now = period_span(month, "month")
    then = period_span(month, "month", -months_back)
    in_now, in_then = within(revenue, "order_at", *now), within(revenue, "order_at", *then)
    amount, scale = whole(revenue, "amount")
    cohort = (
        revenue.filter(in_now | in_then)
        .groupBy(customer)
        .agg(
            F.coalesce(F.sum(F.when(in_then, amount)), F.lit(0)).alias("before"),
            F.coalesce(F.sum(F.when(in_now, amount)), F.lit(0)).alias("after"),
        )
        .filter(F.col("before") > 0)
    )
    before, after = F.col("before"), F.col("after")

    def moved(value: Column, name: str) -> Column:
        if scale != 1.0:
            value = value.cast("decimal(20,0)")
        return F.coalesce(F.sum(value).cast("double") / F.lit(scale), F.lit(0.0)).alias(name)

    return cohort.agg(
        F.count(F.lit(1)).alias("customers"),
        moved(before, "starting"),
        moved(F.when(after > before, after - before), "expansion"),
        moved(F.when((after > 0) & (after < before), before - after), "contraction"),
        moved(F.when(after <= 0, before - after), "churned"),
        moved(after, "ending"),
    ).withColumn("nrr_pct", percent(F.col("ending"), F.col("starting")))


def response_time_p50(
    tickets: DataFrame, responses: DataFrame, as_of: datetime, days: int = 30
) -> DataFrame:
    """Median minutes from the opening of a ticket to its first response.

    ``tickets`` (ticket_id, opened_at) is unique by ticket. Responses are reduced to
    the first one after the opening per ticket; tickets without one do not count. The
    minimum is taken per salt first, so a ticket with very many responses is split.
    """
    opened = tickets.filter(within(tickets, "opened_at", as_of - timedelta(days=days), as_of))
    answers = responses.select("ticket_id", "responded_at")
    first = (
        salted_join(answers, opened, ["ticket_id"], F.col("responded_at"))
        .filter(F.col("responded_at") > F.col("opened_at"))
        .groupBy("ticket_id", "opened_at")
        .agg(F.min("responded_at").alias("responded_at"))
    )
    waited = F.timestamp_diff("MICROSECOND", F.col("opened_at"), F.col("responded_at"))
    return exact_percentile(first, waited, 0.5, "micros").select(
        (F.col("micros") / F.lit(60000000.0)).alias("p50_minutes")
    )


def rates_by_day(days: DataFrame, rates: DataFrame) -> DataFrame:
    """The latest rate at or before each wanted (currency, day).

    Both inputs hold one row per currency and day, so a window per currency is small
    however many orders there are.
    """
    known = rates.select("currency", F.col("rate_day").alias("day"), "rate")
    wanted = days.select("currency", "day").distinct()
    timeline = Window.partitionBy("currency").orderBy("day")
    carried = F.last("rate", ignorenulls=True).over(
        timeline.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        wanted.join(known, ["currency", "day"], "full_outer")
        .select("currency", "day", carried.alias("rate"))
    )


def usd_revenue(
    invoices: DataFrame, refunds: DataFrame, rates: DataFrame, base_currency: str = "USD"
) -> DataFrame:
    """Per currency: invoiced less refunded amounts, converted at the rate of the day.

    Amounts are summed per currency and day before the rate is looked up, so the
    as-of match runs on days and not on invoices. Both inputs carry
    (currency, day, amount). Days before the first rate stay unconverted and counted.
    """
    amount = F.col("amount").cast("double")
    signed = invoices.select("currency", "day", amount.alias("amount")).unionByName(
        refunds.select("currency", "day", (-amount).alias("amount"))
    )
    daily = signed.groupBy("currency", "day").agg(
        exact_decimal(signed, "amount", 4).alias("net"), F.count(F.lit(1)).alias("entries")
    )
    # One timeline per currency: on the same day the rate comes before the amount.
    quoted = rates.select("currency", F.col("rate_day").alias("day"), "rate")
    timeline = Window.partitionBy("currency").orderBy("day", F.col("entries").isNotNull())
    carried = F.last("rate", ignorenulls=True).over(
        timeline.rowsBetween(Window.unboundedPreceding, 0)
    )
    converted_days = (
        daily.unionByName(quoted, allowMissingColumns=True)
        .withColumn("rate", carried)
        .filter(F.col("entries").isNotNull())
    )
    rate = F.when(F.col("currency") == base_currency, F.lit(1).cast("decimal(10,4)")).otherwise(
        F.col("rate")
    )
    in_base = F.col("net").cast("decimal(24,4)") * rate
    return converted_days.groupBy("currency").agg(
        F.sum("net").cast("double").alias("net_local"),
        F.sum(in_base).cast("double").alias("net_usd"),
        F.sum(F.when(rate.isNull(), F.col("entries")).otherwise(0)).alias("unconverted"),
    )


def convert_at_rate(
    amounts: DataFrame, rates: DataFrame, currency: str, day: str, amount: str
) -> DataFrame:
    """Row-level as-of conversion: an equality join on (currency, day), never a range join."""
    wanted = amounts.select(F.col(currency).alias("currency"), F.col(day).alias("day")).distinct()
    table = rates_by_day(wanted, rates).select(
        F.col("currency").alias(currency), F.col("day").alias(day), "rate"
    )
    return amounts.join(table, [currency, day], "left").withColumn(
        f"{amount}_usd", F.col(amount) * F.col("rate")
    )

