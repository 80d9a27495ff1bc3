"""Trust checks: one per rule type, and whole contracts."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.operators import checks, suite
from martwright.plans import views
from martwright.plans.registry import query
from martwright.session import read_table

# When the checks run: the morning after the last full day of events.
AS_OF = datetime(2024, 1, 31, 6, 0, 0)

_RESULT = "metric, rule_type, column_name, status, actual_value, threshold, message"


def _message(label: str, unit: str, limit: str) -> str:
    return (
        f"'{label}: ' || COALESCE(printf('%.1f', actual_value) || '{unit}', 'nothing to compare')"
        f" || ' (threshold: ' || {limit} || ') — ' || upper(status)"
    )


_THRESHOLD = "printf('%.1f', threshold)"


@query(f"""
WITH a AS (
    SELECT 'event_flow' AS metric, 'ts' AS column_name, 12.0::DOUBLE AS threshold,
           date_diff('microsecond', MAX(ts), TIMESTAMP '2024-01-31 06:00:00') / 3600000000.0::DOUBLE
               AS actual_value FROM events
    UNION ALL
    SELECT 'order_flow', 'o_orderdate', 24.0::DOUBLE,
           date_diff('microsecond', MAX(o_orderdate), TIMESTAMP '2024-01-31 06:00:00')
               / 3600000000.0::DOUBLE FROM orders
    UNION ALL
    SELECT 'shipping', 'l_shipdate', 240000.0::DOUBLE,
           date_diff('microsecond', MAX(l_shipdate), TIMESTAMP '2024-01-31 06:00:00')
               / 3600000000.0::DOUBLE FROM lineitem),
s AS (SELECT *, CASE WHEN actual_value < threshold THEN 'passed' ELSE 'failed' END AS status FROM a)
SELECT metric, 'freshness' AS rule_type, column_name, status, actual_value, threshold,
       {_message('Freshness', 'h', f"'< ' || {_THRESHOLD} || 'h'")} AS message FROM s
""")
def check_freshness(spark: SparkSession, root: str) -> DataFrame:
    tables = {t: read_table(spark, root, t) for t in ("events", "orders", "lineitem")}

    def contract(metric: str, table: str, column: str, limit: str) -> dict:
        rules = [{"freshness": {"column": column, "max": limit}}]
        return {"metric": metric, "table": table, "time_column": column, "trust": rules}

    return checks.evaluate(
        [
            contract("event_flow", "events", "ts", "12 hours"),
            contract("order_flow", "orders", "o_orderdate", "1 day"),
            contract("shipping", "lineitem", "l_shipdate", "10000 days"),
        ],
        tables,
        AS_OF,
    )


@query(f"""
WITH j AS (SELECT l.quality, l.toxic, d.source FROM documents d LEFT JOIN labels l USING (doc_id)),
a AS (
    SELECT 'quality' AS column_name, 70.0::DOUBLE AS threshold,
           100.0::DOUBLE * COUNT(*) FILTER (WHERE quality IS NULL) / COUNT(*) AS actual_value FROM j
    UNION ALL SELECT 'toxic', 5.0::DOUBLE,
           100.0::DOUBLE * COUNT(*) FILTER (WHERE toxic IS NULL) / COUNT(*) FROM j
    UNION ALL SELECT 'source', 0.0::DOUBLE,
           100.0::DOUBLE * COUNT(*) FILTER (WHERE source IS NULL) / COUNT(*) FROM j),
s AS (SELECT *, CASE WHEN actual_value < threshold OR (threshold = 0 AND actual_value = 0)
                     THEN 'passed' ELSE 'failed' END AS status FROM a)
SELECT 'labelling' AS metric, 'null_rate' AS rule_type, column_name, status, actual_value,
       threshold, 'Null rate on ' || column_name || ': ' || printf('%.1f', actual_value)
       || '% (threshold: < ' || {_THRESHOLD} || '%) — ' || upper(status) AS message FROM s
""")
def check_null_rate(spark: SparkSession, root: str) -> DataFrame:
    contract = {
        "metric": "labelling",
        "table": "labelled",
        "trust": [
            {"null_rate": {"column": "quality", "max": "70%"}},
            {"null_rate": {"column": "toxic", "max": "5%"}},
            {"null_rate": {"column": "source", "max": "0%"}},
        ],
    }
    return checks.evaluate([contract], {"labelled": views.labelled_documents(spark, root)}, AS_OF)


_DAILY = """
    SELECT event_type, CAST(ts AS DATE) AS period, COUNT(*) AS row_count,
           CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value,
           CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / COUNT(value) AS mean
    FROM events GROUP BY 1, 2
"""
_KEYS = ["event_type"]


def _daily(spark: SparkSession, root: str) -> DataFrame:
    return checks.per_period(views.events(spark, root), "ts", "day", "value", _KEYS)


@query(f"""
WITH d AS ({_DAILY}),
l AS (SELECT *, LAG(row_count) OVER (PARTITION BY event_type ORDER BY period) AS previous FROM d),
p AS (SELECT *, 100.0::DOUBLE * (previous - row_count) / previous AS drop_pct FROM l)
SELECT event_type, period, row_count, previous, drop_pct,
       CASE WHEN drop_pct > 20 THEN 'failed' ELSE 'passed' END AS status FROM p
""")
def check_volume_dod(spark: SparkSession, root: str) -> DataFrame:
    return checks.volume_series(_daily(spark, root), 20, _KEYS)


@query(f"""
WITH d AS ({_DAILY}),
m AS (SELECT *, quantile_cont(CAST(row_count AS DOUBLE), 0.5) OVER (
          PARTITION BY event_type ORDER BY period ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
          AS median FROM d)
SELECT event_type, period, row_count, median,
       CASE WHEN row_count < median * 0.8::DOUBLE THEN 'failed' ELSE 'passed' END AS status FROM m
""")
def check_volume_median(spark: SparkSession, root: str) -> DataFrame:
    return checks.volume_median_series(_daily(spark, root), 80, 7, _KEYS)


@query(f"""
WITH a AS (
    SELECT 'order_value' AS metric, 'o_totalprice' AS column_name,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS actual_value,
           1.0::DOUBLE AS lo, 10000000000.0::DOUBLE AS hi FROM orders
    UNION ALL
    SELECT 'line_value', 'l_extendedprice',
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE),
           0.0::DOUBLE, 100000.0::DOUBLE FROM lineitem),
s AS (SELECT *, CASE WHEN actual_value BETWEEN lo AND hi THEN 'passed' ELSE 'failed' END AS status
      FROM a)
SELECT metric, 'range' AS rule_type, column_name, status, actual_value, hi AS threshold,
       {_message('Value range', '', f"printf('%.1f', lo) || ' to ' || printf('%.1f', hi)")} AS message FROM s
""")
def check_value_range(spark: SparkSession, root: str) -> DataFrame:
    tables = {t: read_table(spark, root, t) for t in ("orders", "lineitem")}
    return checks.evaluate(
        [
            {
                "metric": "order_value",
                "table": "orders",
                "value_column": "o_totalprice",
                "digits": 2,
                "trust": [{"range": {"min": "1", "max": "10,000,000,000"}}],
            },
            {
                "metric": "line_value",
                "table": "lineitem",
                "value_column": "l_extendedprice",
                "digits": 2,
                "trust": [{"range": {"min": 0, "max": "100,000"}}],
            },
        ],
        tables,
        AS_OF,
    )


@query("""
WITH m AS (
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS value
    FROM orders GROUP BY 1),
l AS (SELECT *, LAG(value) OVER (ORDER BY period) AS previous FROM m),
c AS (SELECT *, abs(100.0::DOUBLE * (value - previous) / previous) AS change_pct FROM l)
SELECT period, value, previous, change_pct,
       CASE WHEN change_pct > 15 THEN 'failed' ELSE 'passed' END AS status FROM c
""")
def check_value_change(spark: SparkSession, root: str) -> DataFrame:
    monthly = checks.per_period(
        views.orders(spark, root), "order_at", "month", "amount"
    )
    return checks.change_series(monthly, 15)


def _duplicate_sql(name: str, table: str, columns: str) -> str:
    return f"""SELECT '{name}' AS key_name, CAST(SUM(n) AS BIGINT) AS row_count,
        COUNT(*) AS distinct_count,
        100.0::DOUBLE * (CAST(SUM(n) AS BIGINT) - COUNT(*)) / CAST(SUM(n) AS BIGINT)
            AS duplicate_pct
        FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY {columns})"""


@query(
    " UNION ALL ".join(
        [
            _duplicate_sql("order", "orders", "o_orderkey"),
            _duplicate_sql("line", "lineitem", "l_orderkey, l_linenumber"),
            _duplicate_sql("document text", "documents", "text"),
        ]
    )
)
def check_duplicate_rate(spark: SparkSession, root: str) -> DataFrame:
    """Long texts are compared by a digest, so that the shuffle carries no whole text."""
    texts = read_table(spark, root, "documents").select(F.sha2("text", 256).alias("digest"))
    rates = {
        "order": checks.duplicate_rates(read_table(spark, root, "orders"), "o_orderkey"),
        "line": checks.duplicate_rates(
            read_table(spark, root, "lineitem"), "l_orderkey", "l_linenumber"
        ),
        "document text": checks.duplicate_rates(texts, "digest"),
    }
    rows = [r.select(F.lit(name).alias("key_name"), "*") for name, r in rates.items()]
    return reduce(DataFrame.unionByName, rows)


_DRIFT_SQL = """
h AS (
    SELECT user_id AS metric, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS run,
           event_type AS column_name,
           CASE WHEN MAX(value) >= 100 THEN 'decimal(5,2)' WHEN MAX(value) >= 10
                THEN 'decimal(4,2)' ELSE 'decimal(3,2)' END AS column_type
    FROM events GROUP BY 1, 2, 3)
"""


def schema_history(spark: SparkSession, root: str) -> DataFrame:
    """Each user is a feed: the event types of a day are its columns, typed by their values."""
    widest = F.max("value")
    column_type = (
        F.when(widest >= 100, "decimal(5,2)").when(widest >= 10, "decimal(4,2)")
    ).otherwise("decimal(3,2)")
    day = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return (
        views.events(spark, root)
        .groupBy(
            F.col("user_id").alias("metric"),
            day.cast("bigint").alias("run"),
            F.col("event_type").alias("column_name"),
        )
        .agg(column_type.alias("column_type"))
    )


@query(f"""
WITH {_DRIFT_SQL},
r AS (SELECT metric, run, LEAD(run) OVER (PARTITION BY metric ORDER BY run) AS next_run
      FROM (SELECT DISTINCT metric, run FROM h)),
b AS (SELECT h.metric, next_run AS run, column_name, column_type AS old_type
      FROM h JOIN r ON r.metric = h.metric AND r.run = h.run WHERE next_run IS NOT NULL),
a AS (SELECT h.metric, h.run, column_name, column_type AS new_type
      FROM h JOIN r ON r.metric = h.metric AND r.next_run = h.run)
SELECT COALESCE(b.metric, a.metric) AS metric, COALESCE(b.run, a.run) AS run,
       COALESCE(b.column_name, a.column_name) AS column_name,
       CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed'
            ELSE 'retyped' END AS change, old_type, new_type
FROM b FULL OUTER JOIN a ON a.metric = b.metric AND a.run = b.run AND a.column_name = b.column_name
WHERE old_type IS DISTINCT FROM new_type
""")
def check_schema_drift(spark: SparkSession, root: str) -> DataFrame:
    return checks.schema_drift(schema_history(spark, root))


@query(f"""
WITH {_DRIFT_SQL}
SELECT metric, run, sha256(string_agg(column_name || ':' || column_type, ','
                                      ORDER BY column_name || ':' || column_type)) AS fingerprint
FROM h GROUP BY 1, 2
""")
def schema_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return checks.fingerprint(schema_history(spark, root))


@query(f"""
WITH d AS ({_DAILY}),
l AS (SELECT *, LAG(mean) OVER (PARTITION BY event_type ORDER BY period) AS previous FROM d),
c AS (SELECT *, abs(100.0::DOUBLE * (mean - previous) / previous) AS change_pct FROM l)
SELECT event_type, period, mean, previous, change_pct,
       CASE WHEN change_pct > 25 THEN 'failed' ELSE 'passed' END AS status FROM c
""")
def check_distribution_shift(spark: SparkSession, root: str) -> DataFrame:
    return checks.change_series(_daily(spark, root), 25, "mean", _KEYS)


@query(f"""
WITH a AS (
    SELECT 'events' AS metric, COUNT(*)::DOUBLE AS actual_value, 1000.0::DOUBLE AS threshold FROM events
    UNION ALL SELECT 'orders', COUNT(*)::DOUBLE, 1000000000.0::DOUBLE FROM orders
    UNION ALL SELECT 'lineitem', COUNT(*)::DOUBLE, 500.0::DOUBLE FROM lineitem),
s AS (SELECT *, CASE WHEN actual_value > threshold THEN 'passed' ELSE 'failed' END AS status FROM a)
SELECT metric, 'row_count' AS rule_type, NULL::VARCHAR AS column_name, status, actual_value,
       threshold, {_message('Row count', '', f"'> ' || {_THRESHOLD}")} AS message FROM s
""")
def check_row_floor(spark: SparkSession, root: str) -> DataFrame:
    floors = {"events": 1000, "orders": 1_000_000_000, "lineitem": 500}
    contracts = [
        {"metric": t, "table": t, "trust": [{"row_count": {"min": n}}]} for t, n in floors.items()
    ]
    return checks.evaluate(contracts, {t: read_table(spark, root, t) for t in floors}, AS_OF)


@query(f"""
WITH d AS ({_DAILY}),
t AS (SELECT *, CAST(SUM(CAST(value AS DECIMAL(28,4))) OVER w AS DOUBLE) / COUNT(value) OVER w
          AS trailing_avg
      FROM d WINDOW w AS (PARTITION BY event_type ORDER BY period
                          ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, abs(100.0::DOUBLE * (value - trailing_avg) / trailing_avg) AS change_pct FROM t)
SELECT event_type, period, value, trailing_avg, change_pct,
       CASE WHEN change_pct > 15 THEN 'failed' ELSE 'passed' END AS status FROM c
""")
def check_trailing_avg(spark: SparkSession, root: str) -> DataFrame:
    return checks.trailing_average_series(_daily(spark, root), 15, 30, _KEYS)


CONTRACTS = [
    {
        "metric": "Event Value",
        "description": "Sum of the value of all tracked events",
        "owner": "product-analytics",
        "tags": ["product", "engagement"],
        "sources": ["events"],
        "table": "events",
        "value_column": "value",
        "time_column": "ts",
        "digits": 2,
        "trust": [
            {"freshness": {"max": "12 hours", "warn": 6}},
            {"null_rate": {"column": "user_id", "max": "0%"}},
            {"volume": {"max_drop": "20%", "period": "day over day"}},
            {"volume": {"max_drop": "20%", "period": "week over week"}},
            {"range": {"min": 0, "max": "1,000"}},
            {"change": {"max": "30%", "period": "week over week"}},
            {"duplicate_rate": {"column": "event_id", "max": "0%"}},
            {"distribution_shift": {"column": "value", "max": "25%", "period": "day over day"}},
            {"row_count": {"min": 500}},
            {"trailing_average": {"max": "15%", "days": 30}},
        ],
    },
    {
        "metric": "Event Defaults",
        "owner": "product-analytics",
        "table": "events",
        "value_column": "value",
        "time_column": "ts",
    },
    {
        "metric": "Label Coverage",
        "owner": "data-quality",
        "table": "labelled",
        "value_column": "quality",
        "trust": [
            {"null_rate": {"column": "quality", "max": "70%", "warn": "50%"}},
            {"duplicate_rate": {"column": "doc_id", "max": "0%"}},
        ],
    },
]


def contract_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {
        "events": views.events(spark, root),
        "labelled": views.labelled_documents(spark, root),
    }


_EVENT_SPANS = {
    "d1": ("2024-01-30", "2024-01-31"),
    "d2": ("2024-01-29", "2024-01-30"),
    "w1": ("2024-01-22", "2024-01-29"),
    "w2": ("2024-01-15", "2024-01-22"),
    "t30": ("2023-12-31", "2024-01-30"),
}


def _spans(expression: str, prefix: str) -> str:
    return ", ".join(
        f"{expression} FILTER (WHERE ts >= TIMESTAMP '{a}' AND ts < TIMESTAMP '{b}') AS {prefix}{n}"
        for n, (a, b) in _EVENT_SPANS.items()
    )


_SUITE_SQL = f"""
e AS (
    SELECT date_diff('microsecond', MAX(ts), TIMESTAMP '2024-01-31 06:00:00')
               / 3600000000.0::DOUBLE AS age,
           COUNT(*) AS n, COUNT(*) FILTER (WHERE user_id IS NULL) AS no_user,
           COUNT(*) FILTER (WHERE value IS NULL) AS no_value,
           SUM(CAST(value AS DECIMAL(18,4)))::DOUBLE AS total,
           COUNT(DISTINCT CASE WHEN ts >= TIMESTAMP '2023-12-31' AND ts < TIMESTAMP '2024-01-30'
                               THEN CAST(ts AS DATE) END) AS days,
           {_spans('COUNT(*)', 'n_')}, {_spans('COUNT(value)', 'c_')},
           {_spans('SUM(CAST(value AS DECIMAL(18,4)))', 's_')}
    FROM events),
ed AS (SELECT 100.0::DOUBLE * (SUM(k)::BIGINT - COUNT(*)) / SUM(k)::BIGINT AS pct
       FROM (SELECT COUNT(*) AS k FROM events GROUP BY event_id)),
j AS (SELECT 100.0::DOUBLE * COUNT(*) FILTER (WHERE l.quality IS NULL) / COUNT(*) AS no_quality
      FROM documents d LEFT JOIN labels l USING (doc_id)),
jd AS (SELECT 100.0::DOUBLE * (SUM(k)::BIGINT - COUNT(*)) / SUM(k)::BIGINT AS pct
       FROM (SELECT COUNT(*) AS k FROM documents GROUP BY doc_id)),
a AS (
    SELECT 'Event Value' AS metric, 'freshness' AS rule_type, 'ts' AS column_name,
           age AS actual_value, 12.0::DOUBLE AS threshold,
           CASE WHEN age >= 12 THEN 'failed' WHEN age > 6 THEN 'warning' ELSE 'passed' END AS status,
           'Freshness' AS label, 'h' AS unit FROM e
    UNION ALL SELECT 'Event Value', 'null_rate', 'user_id', 100.0::DOUBLE * no_user / n, 0.0,
           CASE WHEN no_user = 0 THEN 'passed' ELSE 'failed' END, 'Null rate on user_id', '%' FROM e
    UNION ALL SELECT 'Event Value', 'volume', NULL, 100.0::DOUBLE * (n_d2 - n_d1) / n_d2, 20.0,
           CASE WHEN 100.0::DOUBLE * (n_d2 - n_d1) / n_d2 > 20 THEN 'failed' ELSE 'passed' END,
           'Row count drop day over day', '%' FROM e
    UNION ALL SELECT 'Event Value', 'volume', NULL, 100.0::DOUBLE * (n_w2 - n_w1) / n_w2, 20.0,
           CASE WHEN 100.0::DOUBLE * (n_w2 - n_w1) / n_w2 > 20 THEN 'failed' ELSE 'passed' END,
           'Row count drop week over week', '%' FROM e
    UNION ALL SELECT 'Event Value', 'range', 'value', total, 1000.0,
           CASE WHEN total BETWEEN 0 AND 1000 THEN 'passed' ELSE 'failed' END, 'Value range', '' FROM e
    UNION ALL SELECT 'Event Value', 'change', 'value',
           abs(100.0::DOUBLE * (s_w1::DOUBLE - s_w2::DOUBLE) / s_w2::DOUBLE), 30.0,
           CASE WHEN abs(100.0::DOUBLE * (s_w1::DOUBLE - s_w2::DOUBLE) / s_w2::DOUBLE) > 30
                THEN 'failed' ELSE 'passed' END, 'Value change week over week', '%' FROM e
    UNION ALL SELECT 'Event Value', 'duplicate_rate', 'event_id', pct, 0.0,
           CASE WHEN pct > 0 THEN 'failed' ELSE 'passed' END, 'Duplicate rate on event_id', '%' FROM ed
    UNION ALL SELECT 'Event Value', 'distribution_shift', 'value',
           abs(100.0::DOUBLE * (s_d1::DOUBLE / c_d1 - s_d2::DOUBLE / c_d2)
               / (s_d2::DOUBLE / c_d2)), 25.0,
           CASE WHEN abs(100.0::DOUBLE * (s_d1::DOUBLE / c_d1 - s_d2::DOUBLE / c_d2)
                         / (s_d2::DOUBLE / c_d2)) > 25 THEN 'failed' ELSE 'passed' END,
           'Mean of value day over day', '%' FROM e
    UNION ALL SELECT 'Event Value', 'row_count', NULL, n::DOUBLE, 500.0,
           CASE WHEN n > 500 THEN 'passed' ELSE 'failed' END, 'Row count', '' FROM e
    UNION ALL SELECT 'Event Value', 'trailing_average', 'value',
           abs(100.0::DOUBLE * (s_d1::DOUBLE - s_t30::DOUBLE / days) / (s_t30::DOUBLE / days)), 15.0,
           CASE WHEN abs(100.0::DOUBLE * (s_d1::DOUBLE - s_t30::DOUBLE / days)
                         / (s_t30::DOUBLE / days)) > 15 THEN 'failed' ELSE 'passed' END,
           'Value against 30 days average', '%' FROM e
    UNION ALL SELECT 'Event Defaults', 'freshness', 'ts', age, 24.0,
           CASE WHEN age >= 24 THEN 'failed' ELSE 'passed' END, 'Freshness', 'h' FROM e
    UNION ALL SELECT 'Event Defaults', 'null_rate', 'value', 100.0::DOUBLE * no_value / n, 5.0,
           CASE WHEN 100.0::DOUBLE * no_value / n < 5 THEN 'passed' ELSE 'failed' END,
           'Null rate on value', '%' FROM e
    UNION ALL SELECT 'Event Defaults', 'volume', NULL, 100.0::DOUBLE * (n_d2 - n_d1) / n_d2, 25.0,
           CASE WHEN 100.0::DOUBLE * (n_d2 - n_d1) / n_d2 > 25 THEN 'failed' ELSE 'passed' END,
           'Row count drop day over day', '%' FROM e
    UNION ALL SELECT 'Label Coverage', 'null_rate', 'quality', no_quality, 70.0,
           CASE WHEN no_quality >= 70 THEN 'failed' WHEN no_quality > 50 THEN 'warning'
                ELSE 'passed' END, 'Null rate on quality', '%' FROM j
    UNION ALL SELECT 'Label Coverage', 'duplicate_rate', 'doc_id', pct, 0.0,
           CASE WHEN pct > 0 THEN 'failed' ELSE 'passed' END, 'Duplicate rate on doc_id', '%' FROM jd),
r AS (
    SELECT metric, rule_type, column_name, status, actual_value, threshold,
           label || ': ' || COALESCE(printf('%.1f', actual_value) || unit, 'nothing to compare')
               || ' (threshold: ' || CASE rule_type
                      WHEN 'freshness' THEN '< ' || {_THRESHOLD} || 'h'
                      WHEN 'null_rate' THEN '< ' || {_THRESHOLD} || '%'
                      WHEN 'range' THEN '0.0 to ' || {_THRESHOLD}
                      WHEN 'row_count' THEN '> ' || {_THRESHOLD}
                      ELSE '<= ' || {_THRESHOLD} || '%' END
               || ') — ' || upper(status) AS message
    FROM a)
"""

_SCORES_SQL = """
scores AS (
    SELECT metric,
           SUM(CASE status WHEN 'passed' THEN 1.0 WHEN 'warning' THEN 0.5 ELSE 0.0 END)::DOUBLE
               AS trust_score,
           COUNT(*) AS trust_total,
           CASE MAX(CASE status WHEN 'passed' THEN 0 WHEN 'warning' THEN 1 WHEN 'failed' THEN 2
                    ELSE 3 END)
                WHEN 0 THEN 'passed' WHEN 1 THEN 'warning' WHEN 2 THEN 'failed' ELSE 'error' END
               AS status,
           COUNT(*) FILTER (WHERE status IN ('failed', 'error')) AS failed
    FROM r GROUP BY 1)
"""


@query(f"WITH {_SUITE_SQL} SELECT {_RESULT} FROM r")
def contract_suite(spark: SparkSession, root: str) -> DataFrame:
    return checks.evaluate(CONTRACTS, contract_tables(spark, root), AS_OF)


@query(f"""
WITH {_SUITE_SQL}, {_SCORES_SQL}
SELECT *, ROUND(100.0::DOUBLE * trust_score / trust_total, 0) AS score_pct,
       CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS scorecard FROM scores
""")
def contract_scores(spark: SparkSession, root: str) -> DataFrame:
    return suite.metric_scores(contract_suite(spark, root))


@query(f"""
WITH {_SUITE_SQL}, {_SCORES_SQL}
SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'passed') AS healthy,
       COUNT(*) FILTER (WHERE status = 'warning') AS warning,
       COUNT(*) FILTER (WHERE status IN ('failed', 'error')) AS failing,
       CASE WHEN COUNT(*) FILTER (WHERE status IN ('failed', 'error')) > 0 THEN 1 ELSE 0 END
           AS exit_code
FROM scores
""")
def suite_summary(spark: SparkSession, root: str) -> DataFrame:
    return suite.suite_summary(contract_scores(spark, root))
