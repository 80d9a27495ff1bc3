"""The marts kept up to date from changes; their SQL forms are those of the marts built anew."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.functions.values import instant
from martwright.operators import incremental
from martwright.operators.incremental import Mart
from martwright.plans import views
from martwright.plans.marts import DAILY_SQL, LTV_SQL
from martwright.plans.registry import query
from martwright.session import scratch_dir
from martwright.sources.files import stamp_loaded
from martwright.sources.load import load, stored_rows

SPLIT = datetime(2000, 1, 1)
BUCKETS = 16


def _loads(spark: SparkSession, root: str) -> list[tuple[str, DataFrame]]:
    """Old orders, new orders, and corrections of every fifth order of both.

    Before its correction such an order is pending, of another customer, later and of twice
    the amount.
    """
    orders = views.orders(spark, root).drop("priority")
    wrong = F.col("order_id") % 5 == 0
    early = orders.withColumns(
        {
            "customer_id": F.when(wrong, F.col("customer_id") + 1).otherwise(F.col("customer_id")),
            "status": F.when(wrong, views.PENDING).otherwise(F.col("status")),
            "amount": F.when(wrong, F.col("amount") * 2).otherwise(F.col("amount")),
            "order_at": F.when(wrong, F.col("order_at") + F.expr("INTERVAL 400 DAYS")).otherwise(
                F.col("order_at")
            ),
        }
    )
    old = F.col("order_at") < instant(SPLIT)
    return [("append", early.filter(old)), ("append", early.filter(~old)), ("merge", orders.filter(wrong))]


def kept_up_to_date(spark: SparkSession, root: str, mart: Mart) -> DataFrame:
    """State of a mart after three loads, each followed by a merge of its changes."""
    folder = scratch_dir(spark, "incremental")
    base = f"{folder}/raw_orders"
    for number, (mode, rows) in enumerate(_loads(spark, root), 1):
        log = f"{folder}/changes/{number}"
        load(
            stamp_loaded(rows, datetime(2001, 8, 1, number)),
            base,
            mode,
            primary_key=["order_id"],
            buckets=BUCKETS,
            changes=log,
        )
        incremental.refresh(
            f"{folder}/mart", mart, spark.read.parquet(log), number, lambda: stored_rows(spark, base), BUCKETS
        )
    return incremental.mart_rows(spark, f"{folder}/mart", mart, BUCKETS)


@query(DAILY_SQL)
def incremental_daily_revenue(spark: SparkSession, root: str) -> DataFrame:
    rows = kept_up_to_date(spark, root, incremental.daily_revenue_mart(views.PAID))
    return incremental.as_daily_revenue(rows, views.ORDERS_AS_OF_TIME)


@query(LTV_SQL)
def incremental_customer_ltv(spark: SparkSession, root: str) -> DataFrame:
    """Corrections take the last order of many customers away, which are looked up again."""
    rows = kept_up_to_date(spark, root, incremental.customer_ltv_mart(views.PAID))
    return incremental.as_customer_ltv(rows, views.customers(spark, root), views.ORDERS_AS_OF_TIME)
