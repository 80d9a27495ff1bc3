"""Business metrics."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.functions.values import rounded, total, within
from martwright.operators import metrics
from martwright.plans import views
from martwright.plans.registry import query
from martwright.session import read_table

_AMOUNT = "CAST(o_totalprice AS DECIMAL(12,2))"


@query(f"""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS orders,
       ROUND(CAST(SUM({_AMOUNT}) AS DOUBLE) / COUNT(*), 2) AS aov
FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 0 GROUP BY 1
""")
def aov_monthly(spark: SparkSession, root: str) -> DataFrame:
    return metrics.average_order_value(views.orders(spark, root), views.PAID)


@query("""
WITH inv AS (
    SELECT l_orderkey, SUM(net + net * CAST(l_tax AS DECIMAL(5,2))) AS gross
    FROM (SELECT l_orderkey, l_tax, l_linestatus,
                 CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))
                     AS net
          FROM lineitem)
    WHERE l_linestatus = 'F' GROUP BY 1)
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, COUNT(*) AS orders,
       CAST(SUM(gross) AS DOUBLE) AS gmv
FROM orders JOIN inv ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1
""")
def gmv(spark: SparkSession, root: str) -> DataFrame:
    return metrics.merchandise_revenue(
        views.orders(spark, root), views.invoices(spark, root), views.PAID, "F", digits=6
    )


@query("""
SELECT customer_id, order_at, order_id, status, amount FROM (
    SELECT o_custkey AS customer_id, o_orderdate AS order_at, o_orderkey AS order_id,
           o_orderstatus AS status, o_totalprice AS amount,
           ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
    FROM orders) WHERE rn = 1
""")
def first_order_per_customer(spark: SparkSession, root: str) -> DataFrame:
    return metrics.first_order(views.orders(spark, root))


@query("""
WITH f AS (
    SELECT o_custkey, o_orderstatus,
           ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
    FROM orders),
won AS (SELECT o_custkey FROM f WHERE rn = 1 AND o_orderstatus = 'F')
SELECT COUNT(*) AS total, COUNT(w.o_custkey) AS matched,
       ROUND(100.0::DOUBLE * COUNT(w.o_custkey) / COUNT(*), 2) AS conversion_pct
FROM customer LEFT JOIN won w ON w.o_custkey = c_custkey
""")
def order_conversion(spark: SparkSession, root: str) -> DataFrame:
    """Customers stand for sessions; only the first order of each counts."""
    sessions = read_table(spark, root, "customer").select(F.col("c_custkey").alias("customer_id"))
    return metrics.order_conversion(
        sessions, views.orders(spark, root), "customer_id", views.PAID
    )


@query("""
SELECT CAST(ts AS DATE) AS day, COUNT(DISTINCT user_id) AS dau
FROM events WHERE event_type IN ('view', 'click', 'purchase') AND user_id IS NOT NULL GROUP BY 1
""")
def dau(spark: SparkSession, root: str) -> DataFrame:
    return metrics.daily_active_users(views.events(spark, root), ["view", "click", "purchase"])


@query("""
SELECT DATE '2024-01-30' AS day, COUNT(DISTINCT user_id) AS signups
FROM events WHERE event_type = 'signup' AND CAST(ts AS DATE) = DATE '2024-01-30'
  AND user_id IS NOT NULL
""")
def signups_today(spark: SparkSession, root: str) -> DataFrame:
    return metrics.signups_on(views.events(spark, root), date(2024, 1, 30))


_WEEK = "ts >= TIMESTAMP '2024-01-24' AND ts < TIMESTAMP '2024-01-31'"


def _week_of(spark: SparkSession, root: str, event_type: str) -> DataFrame:
    events = views.events(spark, root)
    start = views.EVENTS_AS_OF - timedelta(days=7)
    return events.filter(
        within(events, "ts", start, views.EVENTS_AS_OF) & (F.col("event_type") == event_type)
    )


@query(f"""
WITH v AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view' AND {_WEEK}),
s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND {_WEEK})
SELECT COUNT(*) AS total, COUNT(s.user_id) AS matched,
       ROUND(100.0::DOUBLE * COUNT(s.user_id) / COUNT(*), 2) AS conversion_pct
FROM v LEFT JOIN s ON s.user_id = v.user_id
""")
def signup_conversion(spark: SparkSession, root: str) -> DataFrame:
    return metrics.conversion_rate(
        _week_of(spark, root, "view"), _week_of(spark, root, "signup"), "user_id"
    )


@query(f"""
SELECT DISTINCT user_id FROM events v WHERE event_type = 'view' AND {_WEEK}
  AND EXISTS (SELECT 1 FROM events s
              WHERE s.user_id = v.user_id AND s.event_type = 'signup' AND {_WEEK.replace('ts', 's.ts')})
""")
def converted_visitors(spark: SparkSession, root: str) -> DataFrame:
    return metrics.converted(
        _week_of(spark, root, "view"), _week_of(spark, root, "signup"), "user_id"
    )


_DAY = "ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31'"


@query(f"""
WITH c AS (SELECT DISTINCT user_id FROM events
           WHERE event_type = 'click' AND value >= 1 AND {_DAY}),
p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND {_DAY})
SELECT COUNT(*) AS carts, COUNT(*) - COUNT(p.user_id) AS abandoned,
       100.0::DOUBLE * (COUNT(*) - COUNT(p.user_id)) / COUNT(*) AS abandonment_pct
FROM c LEFT JOIN p ON p.user_id = c.user_id
""")
def cart_abandonment(spark: SparkSession, root: str) -> DataFrame:
    """Clicks stand for carts, purchases of the same day for checkouts."""
    events = views.events(spark, root)
    carts = events.filter(F.col("event_type") == "click").select(
        F.col("user_id").alias("cart_id"),
        F.col("ts").alias("created_at"),
        F.col("value").alias("items"),
    )
    day = within(events, "ts", views.EVENTS_AS_OF - timedelta(hours=24), views.EVENTS_AS_OF)
    checkouts = events.filter((F.col("event_type") == "purchase") & day).select(
        F.col("user_id").alias("cart_id")
    )
    return metrics.cart_abandonment(carts, checkouts, views.EVENTS_AS_OF)


@query("""
SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events c WHERE event_type = 'click'
  AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase'
                  AND p.user_id = c.user_id AND CAST(p.ts AS DATE) = CAST(c.ts AS DATE))
""")
def abandoned_carts(spark: SparkSession, root: str) -> DataFrame:
    """User-days with a click and no purchase."""
    events = views.events(spark, root).withColumn("day", F.col("ts").cast("date"))
    return metrics.abandoned(
        events.filter(F.col("event_type") == "click"),
        events.filter(F.col("event_type") == "purchase"),
        ["user_id", "day"],
    )


@query("""
WITH sub AS (
    SELECT c_mktsegment AS plan, CAST(c_acctbal AS DECIMAL(12,2)) AS plan_amount,
           CASE WHEN c_acctbal >= 5000 THEN 'annual' ELSE 'monthly' END AS billing_interval
    FROM customer WHERE c_mktsegment <> 'HOUSEHOLD')
SELECT plan, COUNT(*) AS subscriptions,
       COALESCE(CAST(SUM(CASE WHEN billing_interval <> 'annual' THEN plan_amount END)
                     AS DOUBLE), 0.0)
       + COALESCE(CAST(SUM(CASE WHEN billing_interval = 'annual' THEN plan_amount END)
                       AS DOUBLE), 0.0) / 12 AS mrr
FROM sub GROUP BY 1
""")
def mrr_by_plan(spark: SparkSession, root: str) -> DataFrame:
    """Market segments stand for plans, HOUSEHOLD for the trial; large balances bill yearly."""
    segment = F.col("c_mktsegment")
    subscriptions = read_table(spark, root, "customer").select(
        F.when(segment == "HOUSEHOLD", "trial").otherwise(segment).alias("plan_name"),
        F.col("c_acctbal").alias("plan_amount", metadata=views.CENTS),
        F.when(F.col("c_acctbal") >= 5000, "annual").otherwise("monthly").alias("billing_interval"),
        F.lit("active").alias("status"),
    )
    return metrics.recurring_revenue(subscriptions)


@query("""
WITH sub AS (
    SELECT o_custkey, MIN(o_orderdate) AS started_at,
           CASE WHEN MAX(o_orderdate) < TIMESTAMP '2001-05-01' THEN MAX(o_orderdate) END AS ended_at
    FROM orders GROUP BY 1),
f AS (
    SELECT started_at < TIMESTAMP '2001-03-01'
             AND (ended_at IS NULL OR ended_at > TIMESTAMP '2001-03-01') AS active,
           ended_at < TIMESTAMP '2001-04-01' AS gone
    FROM sub)
SELECT DATE '2001-03-01' AS month,
       COUNT(*) FILTER (WHERE active) AS active_at_start,
       COUNT(*) FILTER (WHERE active AND gone) AS churned,
       100.0::DOUBLE * COUNT(*) FILTER (WHERE active AND gone)
           / NULLIF(COUNT(*) FILTER (WHERE active), 0) AS churn_pct
FROM f
""")
def churn_rate(spark: SparkSession, root: str) -> DataFrame:
    """A customer subscribes with the first order and ends with the last one, once 3 months old."""
    last = F.max("order_at")
    idle = last < F.expr("TIMESTAMP_NTZ'2001-05-01 00:00:00'")
    subscriptions = (
        views.orders(spark, root)
        .groupBy("customer_id")
        .agg(F.min("order_at").alias("started_at"), F.when(idle, last).alias("ended_at"))
        .withColumn("plan_name", F.lit("standard"))
        .withColumn("status", F.lit("active"))
    )
    return metrics.churn_rate(subscriptions, date(2001, 3, 1))


@query(f"""
WITH c AS (
    SELECT o_custkey,
           COALESCE(SUM({_AMOUNT}) FILTER (WHERE o_orderdate < TIMESTAMP '2000-08-01'), 0) AS b,
           COALESCE(SUM({_AMOUNT}) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-07-01'), 0) AS a
    FROM orders
    WHERE (o_orderdate >= TIMESTAMP '2000-07-01' AND o_orderdate < TIMESTAMP '2000-08-01')
       OR (o_orderdate >= TIMESTAMP '2001-07-01' AND o_orderdate < TIMESTAMP '2001-08-01')
    GROUP BY 1)
SELECT COUNT(*) AS customers, COALESCE(CAST(SUM(b) AS DOUBLE), 0) AS starting,
       COALESCE(CAST(SUM(a - b) FILTER (WHERE a > b) AS DOUBLE), 0) AS expansion,
       COALESCE(CAST(SUM(b - a) FILTER (WHERE a > 0 AND a < b) AS DOUBLE), 0) AS contraction,
       COALESCE(CAST(SUM(b - a) FILTER (WHERE a <= 0) AS DOUBLE), 0) AS churned,
       COALESCE(CAST(SUM(a) AS DOUBLE), 0) AS ending,
       100.0::DOUBLE * CAST(SUM(a) AS DOUBLE) / NULLIF(CAST(SUM(b) AS DOUBLE), 0) AS nrr_pct
FROM c WHERE b > 0
""")
def nrr(spark: SparkSession, root: str) -> DataFrame:
    return metrics.revenue_retention(views.orders(spark, root), views.MONTH)


@query("""
WITH t AS (
    SELECT user_id, MIN(ts) AS opened_at FROM events WHERE event_type = 'error' GROUP BY 1),
r AS (
    SELECT t.user_id, t.opened_at, MIN(e.ts) AS responded_at
    FROM t JOIN events e ON e.user_id = t.user_id AND e.ts > t.opened_at
    WHERE t.opened_at >= TIMESTAMP '2024-01-01' AND t.opened_at < TIMESTAMP '2024-01-31'
    GROUP BY 1, 2)
SELECT quantile_cont(CAST(date_diff('microsecond', opened_at, responded_at) AS DOUBLE), 0.5)
           / 60000000.0::DOUBLE AS p50_minutes
FROM r
""")
def response_time_p50(spark: SparkSession, root: str) -> DataFrame:
    """A user's first error opens a ticket; the next event of the user answers it."""
    events = views.events(spark, root)
    tickets = (
        events.filter(F.col("event_type") == "error")
        .groupBy(F.col("user_id").alias("ticket_id"))
        .agg(F.min("ts").alias("opened_at"))
    )
    responses = events.select(
        F.col("user_id").alias("ticket_id"), F.col("ts").alias("responded_at")
    )
    return metrics.response_time_p50(tickets, responses, views.EVENTS_AS_OF)


_CURRENCY_SQL = (
    "CASE o_orderpriority "
    + " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in views.CURRENCIES.items())
    + " END"
)


def _currency() -> Column:
    code = F.lit(None).cast("string")
    for priority, currency in views.CURRENCIES.items():
        code = F.when(F.col("priority") == priority, currency).otherwise(code)
    return code


@query(f"""
WITH rates AS (
    SELECT CASE event_type WHEN 'view' THEN 'EUR' WHEN 'click' THEN 'GBP'
                WHEN 'signup' THEN 'CAD' WHEN 'purchase' THEN 'JPY' END AS currency,
           DATE '1995-03-01'
               + CAST(70 * date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER)
               AS rate_day,
           CAST(ROUND(CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) / 30, 4)
                AS DECIMAL(10,4)) AS rate
    FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
o AS (SELECT o_orderkey, {_CURRENCY_SQL} AS currency, CAST(o_orderdate AS DATE) AS day,
             CAST(o_totalprice AS DECIMAL(18,4)) AS amount
      FROM orders WHERE o_orderstatus = 'F'),
s AS (
    SELECT currency, day, amount FROM o
    UNION ALL
    SELECT currency, day,
           -SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))))
    FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
    GROUP BY o_orderkey, currency, day),
d AS (SELECT currency, day, SUM(amount) AS net, COUNT(*) AS entries FROM s GROUP BY 1, 2),
c AS (
    SELECT d.*, CASE WHEN d.currency = 'USD' THEN CAST(1 AS DECIMAL(10,4)) ELSE (
               SELECT max_by(r.rate, r.rate_day) FROM rates r
               WHERE r.currency = d.currency AND r.rate_day <= d.day) END AS rate
    FROM d)
SELECT currency, CAST(SUM(net) AS DOUBLE) AS net_local,
       CAST(SUM(CAST(net AS DECIMAL(24,4)) * rate) AS DOUBLE) AS net_usd,
       CAST(SUM(CASE WHEN rate IS NULL THEN entries ELSE 0 END) AS BIGINT) AS unconverted
FROM c GROUP BY 1
""")
def fx_asof_revenue(spark: SparkSession, root: str) -> DataFrame:
    """Currencies by order priority; daily event means, spread over the years, stand for rates."""
    code = (
        F.when(F.col("event_type") == "view", "EUR")
        .when(F.col("event_type") == "click", "GBP")
        .when(F.col("event_type") == "signup", "CAD")
        .when(F.col("event_type") == "purchase", "JPY")
    )
    offset = F.date_diff(F.col("ts").cast("date"), F.lit(date(2024, 1, 1)))
    events = views.events(spark, root)
    mean = total(events, "value") / F.count(F.lit(1))
    rates = (
        events.filter(F.col("event_type") != "error")
        .groupBy(
            code.alias("currency"),
            F.date_add(F.lit(date(1995, 3, 1)), offset * 70).alias("rate_day"),
        )
        .agg(rounded(mean / 30, 4).cast("decimal(10,4)").alias("rate"))
    )
    orders = (
        views.orders(spark, root)
        .filter(F.col("status") == views.PAID)
        .select(
            "order_id", _currency().alias("currency"),
            F.col("order_at").cast("date").alias("day"), "amount",
        )
    )
    # Refunds take currency and day of their order; combined per order before the join.
    refunds = views.refunds(spark, root)
    per_order = refunds.groupBy("order_id").agg(
        total(refunds, "refund_amount", digits=4).alias("amount")
    )
    credits = orders.select("order_id", "currency", "day").join(per_order, "order_id")
    return metrics.usd_revenue(orders, credits, rates)
