"""Semantic measures, windowed metrics, filters and answers with trust."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.functions.periods import WINDOW_NAMES, window_span
from martwright.functions.values import total
from martwright.operators import history, semantic
from martwright.plans import views
from martwright.plans.history import _RUNS_SQL, daily_runs
from martwright.plans.registry import query
from martwright.session import read_table

# A day inside the last month, so that to-date and whole windows differ.
MID_MONTH = date(2001, 7, 18)

ENTITIES = [
    {
        "entity": "transaction",
        "kind": "fact",
        "table": "orders",
        "description": "Orders with status and amount",
        "primary_key": "order_id",
        "dimensions": ["status", "priority"],
        "measures": [
            {
                "name": "revenue",
                "aggregation": "sum",
                "source": "amount",
                "filter": "status = 'F'",
                "digits": 2,
            },
            {"name": "orders", "aggregation": "count", "source": "*"},
            {"name": "largest_order", "aggregation": "max", "source": "amount"},
            {"name": "avg_order", "aggregation": "avg", "source": "amount", "digits": 2},
            {
                "name": "buyers",
                "aggregation": "count_distinct",
                "source": "customer_id",
                "filter": "status = 'F'",
            },
        ],
        "joins": [{"to": "customer", "column": "customer_id"}],
    },
    {
        "entity": "customer",
        "kind": "dimension",
        "table": "customer",
        "description": "Customers",
        "primary_key": "c_custkey",
        "dimensions": ["c_mktsegment"],
        "joins": [{"to": "market", "column": "c_nationkey"}],
    },
    {
        "entity": "market",
        "kind": "dimension",
        "table": "nation",
        "description": "Nations as markets",
        "primary_key": "n_nationkey",
        "dimensions": ["n_name"],
        "joins": [{"to": "region", "column": "n_regionkey"}],
    },
    {
        "entity": "region",
        "kind": "dimension",
        "table": "region",
        "description": "World regions",
        "primary_key": "r_regionkey",
        "dimensions": ["r_name"],
    },
]


def _tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    dims = {t: read_table(spark, root, t) for t in ("customer", "nation", "region")}
    return {"orders": views.orders(spark, root), **dims}


_STAR = """
FROM orders LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
"""
_AMOUNT = "CAST(o_totalprice AS DECIMAL(12,2))"


@query(f"""
SELECT r_name AS region_r_name, n_name AS market_n_name,
       CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN {_AMOUNT} END) AS DOUBLE) AS revenue,
       COUNT(*) AS orders, MAX(o_totalprice) AS largest_order,
       CAST(SUM({_AMOUNT}) AS DOUBLE) / COUNT(o_totalprice) AS avg_order
{_STAR} GROUP BY 1, 2
""")
def semantic_revenue_by_market(spark: SparkSession, root: str) -> DataFrame:
    return semantic.measure_by(
        ENTITIES,
        _tables(spark, root),
        "transaction",
        ["revenue", "orders", "largest_order", "avg_order"],
        ["region.r_name", "market.n_name"],
    )


@query(f"""
SELECT o_orderpriority AS transaction_priority, c_mktsegment AS customer_c_mktsegment,
       COUNT(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS buyers,
       COUNT(*) AS orders
{_STAR} GROUP BY 1, 2
""")
def semantic_buyers_by_segment(spark: SparkSession, root: str) -> DataFrame:
    return semantic.measure_by(
        ENTITIES,
        _tables(spark, root),
        "transaction",
        ["buyers", "orders"],
        ["transaction.priority", "customer.c_mktsegment"],
    )


def _window_sql(name: str) -> str:
    start, end = window_span(name, MID_MONTH)
    tests = [f"o_orderdate >= TIMESTAMP '{start}'"] if start else []
    tests += [f"o_orderdate < TIMESTAMP '{end}'"] if end else []
    return (
        f"SELECT '{name}' AS time_window, CAST(SUM({_AMOUNT}) AS DOUBLE) AS value,"
        f" COUNT(*) AS row_count FROM orders WHERE {' AND '.join(tests) or 'TRUE'}"
    )


@query(" UNION ALL ".join(_window_sql(name) for name in WINDOW_NAMES))
def metric_windows(spark: SparkSession, root: str) -> DataFrame:
    return semantic.metric_in_windows(
        views.orders(spark, root), "amount", "order_at", MID_MONTH
    )


@query(f"""
SELECT CAST(SUM({_AMOUNT}) AS DOUBLE) AS value, COUNT(*) AS row_count FROM orders
WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2001-01-01'
  AND o_orderstatus <> 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
  AND o_totalprice >= 1000 AND o_totalprice < 400000
""")
def metric_filtered(spark: SparkSession, root: str) -> DataFrame:
    return semantic.metric_value(
        views.orders(spark, root),
        "amount",
        "order_at",
        "last_year",
        MID_MONTH,
        [
            {"column": "status", "op": "!=", "value": "P"},
            {"column": "priority", "op": "in", "value": ["1-URGENT", "2-HIGH"]},
            {"column": "amount", "op": ">=", "value": 1000},
            {"column": "amount", "op": "<", "value": 400000},
        ],
    )


@query(f"""
WITH {_RUNS_SQL},
latest AS (SELECT metric_name, MAX(started_at) AS started_at, max_by(status, started_at) AS status,
                  max_by(value_sum, started_at) AS value_sum FROM runs GROUP BY 1),
v AS (
    SELECT event_type AS metric_name,
           CAST(SUM(CASE WHEN event_type <> 'error' THEN CAST(value AS DECIMAL(12,2)) END)
                AS DOUBLE) AS value
    FROM events GROUP BY 1)
SELECT v.metric_name, COALESCE(value, value_sum) AS value, value IS NULL AS stale,
       CASE WHEN value IS NULL THEN started_at END AS value_from, status AS trust_status
FROM v LEFT JOIN latest l ON l.metric_name = v.metric_name
""")
def metric_with_trust(spark: SparkSession, root: str) -> DataFrame:
    """Total value per event type; the query of one type has failed and its stored value is given."""
    events = views.events(spark, root)
    values = events.groupBy(F.col("event_type").alias("metric_name")).agg(
        total(events, "value", F.col("event_type") != "error").alias("value")
    )
    return semantic.answer_with_trust(values, history.latest_run(daily_runs(spark, root)))
