"""Warehouse values against values reported elsewhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.functions.values import total
from martwright.operators import reconcile as ops
from martwright.plans import views
from martwright.plans.registry import query
from martwright.session import read_table

_NET = "CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))"
_BAND = (
    "CASE WHEN abs(delta) < 0.02 THEN 'pass' WHEN abs(delta) < 0.10 THEN 'warn' ELSE 'fail' END"
)


def _year(column: str) -> Column:
    return F.format_string("revenue_%d", F.year(column))


@query(f"""
WITH o AS (SELECT 'revenue_' || year(o_orderdate) AS metric, * FROM orders),
w AS (SELECT metric, CAST(SUM(CASE WHEN metric <> 'revenue_1996'
                                   THEN CAST(o_totalprice AS DECIMAL(12,2)) END) AS DOUBLE) AS wv
      FROM o GROUP BY 1),
lines AS (SELECT l_orderkey, SUM({_NET}) AS net FROM lineitem GROUP BY 1),
x AS (
    SELECT metric, 'invoice_lines' AS source, CAST(SUM(net) AS DOUBLE) AS value,
           NULL::VARCHAR AS error
    FROM o JOIN lines ON l_orderkey = o_orderkey GROUP BY 1
    UNION ALL
    SELECT metric, 'settled_report',
           CAST(SUM(CASE WHEN o_orderpriority <> '5-LOW' OR o_orderstatus <> 'P'
                         THEN CAST(o_totalprice AS DECIMAL(12,2)) END) AS DOUBLE), NULL
    FROM o GROUP BY 1
    UNION ALL
    SELECT metric, 'old_report',
           CASE WHEN metric <> 'revenue_2001' THEN CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) END,
           CASE WHEN metric = 'revenue_2001' THEN 'report not available' END
    FROM o GROUP BY 1),
d AS (
    SELECT x.*, wv, CASE WHEN error IS NULL THEN
               CASE WHEN wv IS NULL OR wv = 0 THEN 0.0::DOUBLE ELSE (value - wv) / wv END
           END AS delta
    FROM x JOIN w ON w.metric = x.metric)
SELECT metric, 0 AS position, 'warehouse' AS source, wv AS warehouse_value, wv AS value,
       0.0::DOUBLE AS delta, 'pass' AS status, NULL::VARCHAR AS error FROM w
UNION ALL
SELECT metric, 1, source, wv, value, delta,
       CASE WHEN error IS NOT NULL THEN 'fail' ELSE {_BAND} END, error FROM d
""")
def reconcile(spark: SparkSession, root: str) -> DataFrame:
    """Yearly order totals against invoice lines and two reports, one of which fails once.

    The warehouse has no value for 1996.
    """
    orders = views.orders(spark, root).withColumn("metric", _year("order_at"))
    settled = (F.col("priority") != "5-LOW") | (F.col("status") != "P")
    # All figures over orders come from one scan, reduced to one row per year.
    yearly = orders.groupBy("metric").agg(
        total(orders, "amount", F.col("metric") != "revenue_1996").alias("warehouse"),
        total(orders, "amount", settled).alias("settled_report"),
        total(orders, "amount", F.col("metric") != "revenue_2001").alias("old_report"),
    )
    lines = views.line_totals(spark, root)
    invoiced = (
        orders.select("order_id", "metric")
        .join(lines, "order_id")
        .groupBy("metric")
        .agg(total(lines, "net").alias("value"))
    )
    fine = F.lit(None).cast("string")
    broken = F.when(F.col("metric") == "revenue_2001", "report not available")
    parts = [
        invoiced.select(
            "metric", F.lit("invoice_lines").alias("source"), "value", fine.alias("error")
        ),
        *[
            yearly.select(
                "metric", F.lit(c).alias("source"), F.col(c).alias("value"), error.alias("error")
            )
            for c, error in (("settled_report", fine), ("old_report", broken))
        ],
    ]
    warehouse = yearly.select("metric", F.col("warehouse").alias("value"))
    return ops.reconcile(warehouse, warehouse, reduce(DataFrame.unionByName, parts))


@query(f"""
WITH w AS (
    SELECT c_nationkey AS nation, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS wv
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
x AS (
    SELECT s_nationkey AS nation, CAST(SUM({_NET}) AS DOUBLE) AS xv
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
d AS (
    SELECT COALESCE(w.nation, x.nation) AS nation, wv AS warehouse_value, xv AS external_value,
           CASE WHEN wv IS NOT NULL AND xv IS NOT NULL THEN
                CASE WHEN wv = 0 THEN 0.0::DOUBLE ELSE (xv - wv) / wv END END AS delta
    FROM w FULL OUTER JOIN x ON x.nation = w.nation)
SELECT *, CASE WHEN delta IS NULL THEN 'fail' ELSE {_BAND} END AS status FROM d
""")
def reconcile_by_dim(spark: SparkSession, root: str) -> DataFrame:
    """Order value by customer nation against line value by supplier nation.

    Facts are summed by customer and by supplier before they meet the dimensions.
    """
    orders = views.orders(spark, root)
    per_customer = orders.groupBy("customer_id").agg(
        total(orders, "amount").alias("v", metadata=views.CENTS)
    )
    customer = read_table(spark, root, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("nation")
    )
    lines = read_table(spark, root, "lineitem").select(
        F.col("l_suppkey").alias("supplier_id"), views.net_price().alias("net")
    )
    per_supplier = lines.groupBy("supplier_id").agg(total(lines, "net", digits=4).alias("v", metadata=views.FOUR_DIGITS))
    supplier = read_table(spark, root, "supplier").select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_nationkey").alias("nation")
    )
    return ops.reconcile_by_dimension(
        per_customer.join(customer, "customer_id")
        .groupBy("nation")
        .agg(total(per_customer, "v").alias("value")),
        per_supplier.join(supplier, "supplier_id")
        .groupBy("nation")
        .agg(total(per_supplier, "v").alias("value")),
        ["nation"],
    )
