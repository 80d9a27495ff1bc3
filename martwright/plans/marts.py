"""Marts and dashboard figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.functions.values import month_of, scaled, total
from martwright.operators import marts
from martwright.plans import views
from martwright.plans.registry import query
from martwright.session import read_table
from martwright.sources.inventory import preview

DAILY_SQL = """
    SELECT CAST(date_trunc('day', o_orderdate) AS DATE) AS day,
           COUNT(*) AS order_count,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue,
           TIMESTAMP '2001-08-01 00:00:00' AS updated_at
    FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
"""

LTV_SQL = """
    SELECT c.c_custkey AS customer_id, c.c_name AS name, n.n_name AS country,
           COUNT(o.o_orderkey) AS lifetime_orders,
           CAST(COALESCE(SUM(CASE WHEN o.o_orderstatus = 'F'
                THEN CAST(o.o_totalprice AS DECIMAL(12,2)) ELSE 0 END), 0) AS DOUBLE)
               AS lifetime_revenue,
           MAX(o.o_orderdate) AS last_order_at,
           TIMESTAMP '2001-08-01 00:00:00' AS updated_at
    FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN orders o ON o.o_custkey = c.c_custkey
    GROUP BY 1, 2, 3
"""


@query(DAILY_SQL)
def mart_daily_revenue(spark: SparkSession, root: str) -> DataFrame:
    mart = marts.daily_revenue(views.orders(spark, root), views.ORDERS_AS_OF_TIME, views.PAID)
    return scaled(mart, "revenue", 2)


@query(LTV_SQL)
def mart_customer_ltv(spark: SparkSession, root: str) -> DataFrame:
    return marts.customer_ltv(
        views.customers(spark, root),
        views.orders(spark, root),
        views.ORDERS_AS_OF_TIME,
        views.PAID,
    )


@query(f"""
WITH daily AS ({DAILY_SQL})
SELECT CAST(SUM(CAST(revenue AS DECIMAL(38,2))) AS DOUBLE) AS total_revenue,
       CAST(SUM(order_count) AS BIGINT) AS total_orders,
       CAST(SUM(CAST(revenue AS DECIMAL(38,2))) AS DOUBLE) / COUNT(*) AS avg_daily_revenue
FROM daily
""")
def dashboard_kpis(spark: SparkSession, root: str) -> DataFrame:
    return marts.dashboard_kpis(mart_daily_revenue(spark, root))


@query(f"""
WITH ltv AS ({LTV_SQL})
SELECT customer_id, name, country, lifetime_revenue, lifetime_orders
FROM ltv ORDER BY lifetime_revenue DESC, customer_id LIMIT 10
""")
def top_customers(spark: SparkSession, root: str) -> DataFrame:
    return marts.top_customers(mart_customer_ltv(spark, root))


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 100
""")
def preview_rows(spark: SparkSession, root: str) -> DataFrame:
    return preview(read_table(spark, root, "orders"), ["o_orderkey"], 100)


@query("""
WITH spent AS (
    SELECT l_orderkey,
           SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))))
               AS spent
    FROM lineitem GROUP BY 1)
SELECT CAST(SUM(spent) AS DOUBLE) AS spent,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS budgeted,
       COUNT(*) AS lines,
       COUNT(*) FILTER (WHERE spent > CAST(o_totalprice AS DECIMAL(12,2))) AS overspent_lines
FROM orders LEFT JOIN spent ON l_orderkey = o_orderkey
WHERE o_totalprice IS NOT NULL AND spent IS NOT NULL
""")
def budget_utilisation(spark: SparkSession, root: str) -> DataFrame:
    """Order totals as the budget, line totals as the spending; some orders have no lines."""
    spent = views.line_totals(spark, root).withColumnRenamed("net", "spent")
    budget = (
        views.orders(spark, root)
        .select("order_id", F.col("amount").alias("budgeted"))
        .join(spent, "order_id", "left")
    )
    return marts.budget_utilisation(budget)


@query("""
WITH monthly AS (
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS value
    FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
lagged AS (SELECT period, value, LAG(value) OVER (ORDER BY period) AS previous_value FROM monthly)
SELECT period, value, previous_value,
       CASE WHEN previous_value = 0 THEN 0.0::DOUBLE
            ELSE 100.0::DOUBLE * (value - previous_value) / previous_value END AS change_pct
FROM lagged
""")
def value_change_mom(spark: SparkSession, root: str) -> DataFrame:
    orders = views.orders(spark, root)
    monthly = (
        orders.filter(F.col("status") == views.PAID)
        .groupBy(month_of("order_at").alias("period"))
        .agg(total(orders, "amount").alias("value"))
    )
    return marts.period_change(monthly)
