"""Marts and the dashboard figures read from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright.functions.values import instant, percent, ratio, total


def daily_revenue(orders: DataFrame, as_of: datetime, paid: str = "paid") -> DataFrame:
    """Paid orders per day: count and revenue."""
    return (
        orders.filter(F.col("status") == paid)
        .groupBy(F.col("order_at").cast("date").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            total(orders, "amount").alias("revenue"),
        )
        .withColumn("updated_at", instant(as_of))
    )


def customer_ltv(
    customers: DataFrame, orders: DataFrame, as_of: datetime, paid: str = "paid"
) -> DataFrame:
    """Every customer with order count (all statuses), paid revenue and last order.

    Orders are summed per customer before the join, so a customer with very many
    orders reaches the join as one row. ``customer_id`` is unique in ``customers``.
    """
    per_customer = orders.groupBy("customer_id").agg(
        F.count("order_id").alias("lifetime_orders"),
        total(orders, "amount", F.col("status") == paid).alias("paid"),
        F.max("order_at").alias("last_order_at"),
    )
    return customers.join(per_customer, "customer_id", "left").select(
        "customer_id",
        "name",
        "country",
        F.coalesce("lifetime_orders", F.lit(0)).alias("lifetime_orders"),
        F.coalesce("paid", F.lit(0.0)).alias("lifetime_revenue"),
        "last_order_at",
        instant(as_of).alias("updated_at"),
    )


def dashboard_kpis(daily: DataFrame) -> DataFrame:
    """Total revenue, total orders and mean revenue per day over the daily mart."""
    revenue = total(daily, "revenue")
    return daily.agg(
        revenue.alias("total_revenue"),
        F.sum("order_count").alias("total_orders"),
        ratio(revenue, F.count("revenue")).alias("avg_daily_revenue"),
    )


def top_customers(ltv: DataFrame, rows: int = 10) -> DataFrame:
    """Highest lifetime revenue first; the key settles ties."""
    return (
        ltv.orderBy(F.desc("lifetime_revenue"), "customer_id")
        .limit(rows)
        .select("customer_id", "name", "country", "lifetime_revenue", "lifetime_orders")
    )


def budget_utilisation(budget: DataFrame, digits: int | None = None) -> DataFrame:
    """Total spent over the rows where both the budget and the spending are present."""
    return budget.filter(F.col("budgeted").isNotNull() & F.col("spent").isNotNull()).agg(
        total(budget, "spent", digits=digits).alias("spent"),
        total(budget, "budgeted", digits=digits).alias("budgeted"),
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("spent") > F.col("budgeted")).alias("overspent_lines"),
    )


def period_change(values: DataFrame, period: str = "period", value: str = "value") -> DataFrame:
    """Value, previous value and percent change; 0 when the previous value is 0.

    ``values`` holds one row per period, so the single window partition is small.
    """
    previous = F.lag(value).over(Window.orderBy(period))
    changed = values.withColumn("previous_value", previous)
    return changed.withColumn(
        "change_pct",
        F.when(F.col("previous_value") == 0, 0.0).otherwise(
            percent(F.col(value) - F.col("previous_value"), F.col("previous_value"))
        ),
    )
