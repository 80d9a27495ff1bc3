"""The given tables under the column names of the operators.

Views only rename, cast and derive columns; filters on renamed columns still reach
the parquet scan.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.functions.values import money, scaled, total
from martwright.session import read_table

# "Now" of the data: every query gets it as a literal.
EVENTS_AS_OF = datetime(2024, 1, 31)
ORDERS_AS_OF = date(2001, 8, 1)
# Decimal places of floating amounts: what ``values.scaled`` states.
CENTS, FOUR_DIGITS = {"digits": 2}, {"digits": 4}
ORDERS_AS_OF_TIME = datetime(2001, 8, 1)
MONTH = date(2001, 7, 1)

# Order status letters and the words they stand for.
PAID, PENDING, CANCELLED = "F", "O", "P"

# Currency of an order by priority; the first is the base currency.
CURRENCIES = {
    "1-URGENT": "USD",
    "2-HIGH": "EUR",
    "3-MEDIUM": "GBP",
    "4-NOT SPECIFIED": "CAD",
    "5-LOW": "JPY",
}


def orders(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("amount", metadata=CENTS),
        F.col("o_orderdate").alias("order_at"),
        F.col("o_orderpriority").alias("priority"),
    )


def customers(spark: SparkSession, root: str) -> DataFrame:
    nation = read_table(spark, root, "nation")
    rows = read_table(spark, root, "customer")
    return rows.join(nation, rows["c_nationkey"] == nation["n_nationkey"], "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("country"),
    )


def alignment_orders(spark: SparkSession, root: str) -> DataFrame:
    """Orders whose converted amount, invoice or payment can be missing."""
    status = (
        F.when(F.col("o_orderstatus") == PAID, "completed")
        .when(F.col("o_orderstatus") == PENDING, "pending")
        .otherwise("cancelled")
    )
    priority = F.col("o_orderpriority")
    return read_table(spark, root, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        status.alias("status"),
        money("o_totalprice").alias("amount_local"),
        F.when(priority != "4-NOT SPECIFIED", money("o_totalprice")).alias("amount"),
        F.col("o_orderdate").alias("order_date"),
        F.when(priority != "5-LOW", F.col("o_orderdate")).alias("invoiced_at"),
        F.when(~priority.isin("5-LOW", "3-MEDIUM"), F.col("o_orderdate")).alias("paid_at"),
    )


ALIGNMENT_SQL = """
orders_v AS (
    SELECT o_orderkey AS order_id,
           CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
                ELSE 'cancelled' END AS status,
           CAST(o_totalprice AS DECIMAL(12,2)) AS amount_local,
           CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
                THEN CAST(o_totalprice AS DECIMAL(12,2)) END AS amount,
           o_orderdate AS order_date,
           CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS invoiced_at,
           CASE WHEN o_orderpriority NOT IN ('5-LOW', '3-MEDIUM') THEN o_orderdate END AS paid_at
    FROM orders),
refunds_v AS (
    SELECT l_orderkey AS order_id,
           CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))
               AS refund_amount
    FROM lineitem WHERE l_returnflag = 'R')
"""


def net_price() -> Column:
    """Line price after discount: four digits."""
    return F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))


def refunds(spark: SparkSession, root: str) -> DataFrame:
    return (
        read_table(spark, root, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select(
            F.col("l_orderkey").alias("order_id"),
            net_price().alias("refund_amount", metadata=FOUR_DIGITS),
        )
    )


def line_totals(spark: SparkSession, root: str) -> DataFrame:
    """Net line value per order, exact to four digits."""
    lines = read_table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), net_price().alias("net", metadata=FOUR_DIGITS)
    )
    return lines.groupBy("order_id").agg(
        total(lines, "net").alias("net", metadata=FOUR_DIGITS)
    )


def invoices(spark: SparkSession, root: str) -> DataFrame:
    net = net_price()
    return read_table(spark, root, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linestatus").alias("invoice_status"),
        net.alias("net_amount"),
        (net * F.col("l_tax")).alias("tax"),
    )


def events(spark: SparkSession, root: str) -> DataFrame:
    return scaled(read_table(spark, root, "events"), "value", 2)


def labelled_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents with their labels; unlabelled ones have NULL quality."""
    documents = read_table(spark, root, "documents").select("doc_id", "lang", "source")
    return documents.join(read_table(spark, root, "labels"), "doc_id", "left")
