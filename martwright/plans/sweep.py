"""Subscriptions on every day and in every month, against joins with a calendar."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.operators import sweep
from martwright.plans import views
from martwright.plans.registry import query
from martwright.session import read_table

FIRST, LAST = date(2000, 1, 1), date(2001, 7, 31)

_SUBSCRIPTIONS = """
spans AS (
    SELECT o_custkey, MIN(o_orderdate) AS started_at,
           CASE WHEN MAX(o_orderdate) < TIMESTAMP '2001-05-01' THEN MAX(o_orderdate) END AS ended_at
    FROM orders GROUP BY 1),
subs AS (
    SELECT CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'trial' ELSE c_mktsegment END AS plan_name,
           CAST(c_acctbal AS DECIMAL(12,2)) AS plan_amount, c_acctbal >= 5000 AS annual,
           CAST(started_at AS DATE) AS began, CAST(ended_at AS DATE) AS ended
    FROM spans JOIN customer ON c_custkey = o_custkey)
"""


def subscriptions(spark: SparkSession, root: str) -> DataFrame:
    """A customer subscribes with the first order and ends with the last one, once 3 months old.

    Market segments stand for plans, HOUSEHOLD for the trial; large balances bill yearly.
    """
    last = F.max("order_at")
    idle = last < F.expr("TIMESTAMP_NTZ'2001-05-01 00:00:00'")
    spans = (
        views.orders(spark, root)
        .groupBy("customer_id")
        .agg(F.min("order_at").alias("started_at"), F.when(idle, last).alias("ended_at"))
    )
    segment, balance = F.col("c_mktsegment"), F.col("c_acctbal")
    plans = read_table(spark, root, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.when(segment == "HOUSEHOLD", "trial").otherwise(segment).alias("plan_name"),
        balance.alias("plan_amount"),
        F.when(balance >= 5000, "annual").otherwise("monthly").alias("billing_interval"),
        F.lit("active").alias("status"),
    )
    return spans.join(plans, "customer_id")


@query(f"""
WITH {_SUBSCRIPTIONS},
days AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS day),
plans AS (SELECT DISTINCT plan_name FROM subs WHERE ended IS NULL OR ended > began)
SELECT p.plan_name AS plan, day, COUNT(s.began) AS active,
       COALESCE(CAST(SUM(CASE WHEN NOT annual AND s.plan_name <> 'trial' THEN plan_amount END) AS DOUBLE), 0)
       + COALESCE(CAST(SUM(CASE WHEN annual AND s.plan_name <> 'trial' THEN plan_amount END) AS DOUBLE), 0) / 12
           AS mrr
FROM plans p CROSS JOIN days LEFT JOIN subs s
  ON s.plan_name = p.plan_name AND s.began <= day AND (s.ended IS NULL OR s.ended > day)
GROUP BY 1, 2
""")
def subscriptions_by_day(spark: SparkSession, root: str) -> DataFrame:
    return sweep.active_by_day(subscriptions(spark, root), FIRST, LAST)


@query(f"""
WITH {_SUBSCRIPTIONS},
months AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 MONTH)) AS DATE) AS month),
f AS (SELECT month, s.began < month AND (s.ended IS NULL OR s.ended > month) AS active,
             s.ended < month + INTERVAL 1 MONTH AS gone
      FROM months CROSS JOIN (SELECT * FROM subs WHERE plan_name <> 'trial') s)
SELECT month, COUNT(*) FILTER (WHERE active) AS active_at_start,
       COUNT(*) FILTER (WHERE active AND gone) AS churned,
       100.0::DOUBLE * COUNT(*) FILTER (WHERE active AND gone)
           / NULLIF(COUNT(*) FILTER (WHERE active), 0) AS churn_pct
FROM f GROUP BY 1
""")
def churn_by_month(spark: SparkSession, root: str) -> DataFrame:
    return sweep.churn_by_month(subscriptions(spark, root), FIRST, LAST.replace(day=1))
