"""Four definitions of monthly revenue, compared and explained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.operators import revenue
from martwright.plans import views
from martwright.plans.registry import query

_MONTH = "order_date >= TIMESTAMP '2001-07-01' AND order_date < TIMESTAMP '2001-08-01'"
_ROLLING = "order_date >= TIMESTAMP '2001-07-02'"
_WHERE = {
    "engineering": f"status <> 'cancelled' AND {_MONTH}",
    "analytics": f"status = 'completed' AND {_ROLLING}",
    "finance": "status = 'completed' AND invoiced_at IS NOT NULL AND paid_at IS NOT NULL"
    f" AND amount IS NOT NULL AND {_MONTH}",
    "aligned": f"status = 'completed' AND amount IS NOT NULL AND {_MONTH}",
}
_AMOUNT = {
    "engineering": "COALESCE(amount, amount_local)",
    "analytics": "COALESCE(amount, amount_local)",
    "finance": "amount",
    "aligned": "amount",
}


def _value_sql(name: str) -> str:
    value = f"(SELECT SUM({_AMOUNT[name]}) FROM orders_v WHERE {_WHERE[name]})"
    if name != "engineering":
        value += (
            " - COALESCE((SELECT SUM(refund_amount) FROM refunds_v JOIN orders_v USING (order_id)"
            f" WHERE {_WHERE[name]}), 0)"
        )
    if name == "aligned":
        value = f"ROUND({value}, 2)"
    return f"CAST({value} AS DOUBLE)"


def _sql(name: str) -> str:
    return f"WITH {views.ALIGNMENT_SQL} SELECT {_value_sql(name)} AS monthly_revenue"


def _value(spark: SparkSession, root: str, definition: revenue.Definition) -> DataFrame:
    return revenue.monthly_revenue(
        views.alignment_orders(spark, root),
        views.refunds(spark, root),
        definition,
        views.MONTH,
        views.ORDERS_AS_OF,
    )


@query(_sql("engineering"))
def def_engineering(spark: SparkSession, root: str) -> DataFrame:
    return _value(spark, root, revenue.ENGINEERING)


@query(_sql("analytics"))
def def_analytics(spark: SparkSession, root: str) -> DataFrame:
    return _value(spark, root, revenue.ANALYTICS)


@query(_sql("finance"))
def def_finance(spark: SparkSession, root: str) -> DataFrame:
    return _value(spark, root, revenue.FINANCE)


@query(_sql("aligned"))
def def_aligned(spark: SparkSession, root: str) -> DataFrame:
    return _value(spark, root, revenue.ALIGNED)


@query(
    f"WITH {views.ALIGNMENT_SQL}, v AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS definition, {_value_sql(n)} AS monthly_revenue" for n in _WHERE
    )
    + """)
SELECT definition, monthly_revenue,
       monthly_revenue - (SELECT monthly_revenue FROM v WHERE definition = 'aligned')
           AS delta_to_aligned
FROM v"""
)
def definition_compare(spark: SparkSession, root: str) -> DataFrame:
    return revenue.definition_compare(
        views.alignment_orders(spark, root),
        views.refunds(spark, root),
        views.MONTH,
        views.ORDERS_AS_OF,
    )


_GAP_SQL = f"""
WITH {views.ALIGNMENT_SQL},
r AS (SELECT order_id, SUM(refund_amount) AS refund FROM refunds_v GROUP BY 1),
o AS (
    SELECT o.*, COALESCE(refund, 0) AS refund,
           COALESCE({_WHERE['engineering']}, FALSE) AS in_e,
           COALESCE({_WHERE['analytics']}, FALSE) AS in_n,
           COALESCE({_WHERE['finance']}, FALSE) AS in_f,
           COALESCE({_WHERE['aligned']}, FALSE) AS in_a,
           {_MONTH} AS in_month, {_ROLLING} AS in_rolling
    FROM orders_v o LEFT JOIN r USING (order_id)),
p AS (
    SELECT *,
           CASE WHEN in_a THEN amount - refund ELSE 0 END AS part_a,
           CASE WHEN in_e THEN COALESCE(amount, amount_local) ELSE 0 END AS part_e,
           CASE WHEN in_n THEN COALESCE(amount, amount_local) - refund ELSE 0 END AS part_n,
           CASE WHEN in_f THEN amount - refund ELSE 0 END AS part_f,
           CASE WHEN status <> 'completed' THEN 'status' WHEN NOT in_month THEN 'period'
                WHEN amount IS NULL THEN 'currency' END AS out_of_a
    FROM o),
g AS (
    SELECT 'engineering' AS definition, part_e - part_a AS delta,
           CASE WHEN in_e AND NOT in_a THEN out_of_a
                WHEN in_a AND in_e AND refund <> 0 THEN 'refunds' END AS reason FROM p
    UNION ALL
    SELECT 'analytics', part_n - part_a,
           CASE WHEN in_n AND NOT in_a THEN out_of_a
                WHEN in_a AND NOT in_n THEN 'period' END FROM p
    UNION ALL
    SELECT 'finance', part_f - part_a,
           CASE WHEN in_a AND NOT in_f THEN 'settlement' END FROM p)
SELECT definition, reason, COUNT(*) AS orders, CAST(SUM(delta) AS DOUBLE) AS delta
FROM g WHERE reason IS NOT NULL GROUP BY 1, 2
"""


@query(_GAP_SQL)
def definition_gap(spark: SparkSession, root: str) -> DataFrame:
    return revenue.definition_gap(
        views.alignment_orders(spark, root),
        views.refunds(spark, root),
        views.MONTH,
        views.ORDERS_AS_OF,
    )


def _switched(own: dict[str, str]) -> str:
    """Value of an order under the choices that ``taken`` takes over from a definition."""
    base = {
        "status": "status = 'completed'", "period": _MONTH, "currency": "amount IS NOT NULL",
        "settlement": "TRUE", "gross": "amount", "refunds": "refund",
    }
    met = " AND ".join(
        f"COALESCE(CASE WHEN taken & {1 << i} <> 0 THEN {own.get(c, base[c])} ELSE {base[c]} END, FALSE)"
        for i, c in enumerate(("status", "period", "currency", "settlement"))
    )
    gross = f"CASE WHEN taken & 4 <> 0 THEN {own.get('gross', 'amount')} ELSE amount END"
    refund = f"CASE WHEN taken & 16 <> 0 THEN {own.get('refunds', 'refund')} ELSE refund END"
    return f"CASE WHEN {met} THEN COALESCE({gross}, 0) - {refund} ELSE 0 END"


_OWN = {
    "engineering": {
        "status": "status <> 'cancelled'", "currency": "TRUE",
        "gross": "COALESCE(amount, amount_local)", "refunds": "0",
    },
    "analytics": {
        "period": _ROLLING, "currency": "TRUE", "gross": "COALESCE(amount, amount_local)",
    },
    "finance": {"settlement": "invoiced_at IS NOT NULL AND paid_at IS NOT NULL"},
}


@query(
    f"""
WITH {views.ALIGNMENT_SQL},
r AS (SELECT order_id, SUM(refund_amount) AS refund FROM refunds_v GROUP BY 1),
o AS (SELECT o.*, COALESCE(refund, 0) AS refund FROM orders_v o LEFT JOIN r USING (order_id)),
s AS (SELECT unnest(range(32)) AS taken),
v AS ("""
    + " UNION ALL ".join(
        f"SELECT '{n}' AS definition, taken, SUM({_switched(own)}) AS v FROM o, s GROUP BY taken"
        for n, own in _OWN.items()
    )
    + """),
c(bit, choice) AS (VALUES (0, 'status'), (1, 'period'), (2, 'currency'), (3, 'settlement'), (4, 'refunds'))
SELECT definition, choice,
       CAST(SUM(v * CASE WHEN (taken >> bit) & 1 = 1
                         THEN [24, 6, 4, 6, 24][bit_count(taken)]
                         ELSE -[24, 6, 4, 6, 24][bit_count(taken) + 1] END) AS DOUBLE) / 120 AS delta
FROM v, c GROUP BY 1, 2"""
)
def definition_shares(spark: SparkSession, root: str) -> DataFrame:
    """The difference to the aligned definition, split evenly over all orders of the choices."""
    return revenue.definition_shares(
        views.alignment_orders(spark, root),
        views.refunds(spark, root),
        views.MONTH,
        views.ORDERS_AS_OF,
    )


@query(f"""
WITH {views.ALIGNMENT_SQL},
e AS (SELECT order_id FROM orders_v WHERE {_WHERE['engineering']}),
f AS (SELECT order_id FROM orders_v WHERE {_WHERE['analytics']})
SELECT CASE WHEN f.order_id IS NULL THEN 'left only' WHEN e.order_id IS NULL THEN 'right only'
            ELSE 'both' END AS side, COUNT(*) AS orders
FROM e FULL OUTER JOIN f ON e.order_id = f.order_id GROUP BY 1
""")
def definition_membership(spark: SparkSession, root: str) -> DataFrame:
    """Which orders the engineering and the analytics definition count, and which both do."""
    rows = views.alignment_orders(spark, root)
    sides = [
        revenue.qualifying(rows, d, views.MONTH, views.ORDERS_AS_OF)
        for d in (revenue.ENGINEERING, revenue.ANALYTICS)
    ]
    found = revenue.membership(*sides, ["order_id"])
    return found.groupBy("side").agg(F.count(F.lit(1)).alias("orders"))
