"""Data tests over the given tables; a query returns the offending rows."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.operators import data_tests
from martwright.plans import views
from martwright.plans.marts import mart_daily_revenue
from martwright.plans.registry import query
from martwright.session import read_table

# Two days after the last event.
LATE = datetime(2024, 2, 2)


@query("""
SELECT COUNT(*) AS row_count FROM customer
WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) HAVING COUNT(*) = 0
""")
def test_not_empty(spark: SparkSession, root: str) -> DataFrame:
    """No customer is of an unknown nation, so that table is found to be empty."""
    nations = read_table(spark, root, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    stray = read_table(spark, root, "customer").join(nations, "c_nationkey", "left_anti")
    return data_tests.not_empty(stray)


@query("""
SELECT MAX(ts) AS newest FROM events
HAVING MAX(ts) < TIMESTAMP '2024-02-02' - INTERVAL 24 HOURS
""")
def test_freshness(spark: SparkSession, root: str) -> DataFrame:
    return data_tests.not_stale(views.events(spark, root), "ts", LATE, 24)


@query("""
SELECT d.doc_id, d.source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE l.quality IS NULL
""")
def test_null_key(spark: SparkSession, root: str) -> DataFrame:
    rows = views.labelled_documents(spark, root)
    return data_tests.null_rows(rows, "quality", ["doc_id", "source"])


@query("""
SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 10000 OR o_totalprice > 450000
""")
def test_value_range(spark: SparkSession, root: str) -> DataFrame:
    rows = read_table(spark, root, "orders")
    return data_tests.out_of_range(
        rows, "o_totalprice", 10000, 450000, ["o_orderkey", "o_totalprice"]
    )


@query("""
SELECT l_orderkey, l_linenumber, COUNT(*) AS row_count FROM lineitem
GROUP BY 1, 2 HAVING COUNT(*) > 1
""")
def test_unique_key(spark: SparkSession, root: str) -> DataFrame:
    return data_tests.duplicate_keys(
        read_table(spark, root, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


def suite(spark: SparkSession, root: str) -> DataFrame:
    """Declared tests on three tables, key tests, and SQL tests.

    One SQL test cannot be analysed and one fails while it runs.
    """
    lineitem = read_table(spark, root, "lineitem")
    mart = mart_daily_revenue(spark, root)
    documents = views.labelled_documents(spark, root)
    orders = read_table(spark, root, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    view = f"daily_{uuid.uuid4().hex}"
    mart.createOrReplaceTempView(view)
    dt = data_tests
    results = dt.data_test_suite(
        spark,
        declared=[
            (
                views.events(spark, root),
                [
                    dt.expect_rows("events_not_empty"),
                    dt.expect_fresh("events_fresh", "ts", LATE),
                    dt.expect_key("events_user_present", "user_id"),
                    dt.expect_range("events_value_range", "value", 0, 100),
                ],
            ),
            (
                lineitem,
                [
                    dt.expect_rows("lines_not_empty"),
                    dt.expect_range("lines_quantity_range", "l_quantity", 1, 45),
                    dt.expect_key("lines_order_present", "l_orderkey"),
                ],
            ),
            (documents, [dt.expect_key("documents_quality_present", "quality")]),
        ],
        custom={
            "lines_unique": lambda: dt.duplicate_keys(lineitem, ["l_orderkey", "l_linenumber"]),
            "lines_have_orders": lambda: lineitem.join(orders, "l_orderkey", "left_anti"),
            "mart_revenue_positive": f"SELECT day FROM {view} WHERE revenue <= 0",
            "mart_broken": f"SELECT missing_column FROM {view}",
            "mart_divides": f"SELECT day FROM {view} WHERE revenue / (revenue - revenue) > 1",
        },
    )
    spark.catalog.dropTempView(view)
    return results


_SUITE_SQL = """
counts AS (
    SELECT 'events_not_empty' AS name, CASE WHEN COUNT(*) < 1 THEN 1 ELSE 0 END AS problem_rows FROM events
    UNION ALL SELECT 'events_fresh', CASE WHEN MAX(ts) < TIMESTAMP '2024-02-01' THEN 1 ELSE 0 END FROM events
    UNION ALL SELECT 'events_user_present', COUNT(*) FILTER (WHERE user_id IS NULL) FROM events
    UNION ALL SELECT 'events_value_range', COUNT(*) FILTER (WHERE value < 0 OR value > 100) FROM events
    UNION ALL SELECT 'lines_not_empty', CASE WHEN COUNT(*) < 1 THEN 1 ELSE 0 END FROM lineitem
    UNION ALL SELECT 'lines_quantity_range',
        COUNT(*) FILTER (WHERE l_quantity < 1 OR l_quantity > 45) FROM lineitem
    UNION ALL SELECT 'lines_order_present', COUNT(*) FILTER (WHERE l_orderkey IS NULL) FROM lineitem
    UNION ALL SELECT 'documents_quality_present', COUNT(*) FILTER (WHERE l.quality IS NULL)
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
    UNION ALL SELECT 'lines_unique', COUNT(*) FROM (
        SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)
    UNION ALL SELECT 'lines_have_orders', COUNT(*) FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'mart_revenue_positive', COUNT(*) FROM (
        SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'F'
        GROUP BY 1 HAVING SUM(o_totalprice) <= 0)),
results AS (
    SELECT name, CAST(problem_rows AS BIGINT) AS problem_rows,
           CASE WHEN problem_rows > 0 THEN 'failed' ELSE 'passed' END AS status,
           CASE WHEN problem_rows > 0 THEN problem_rows || ' problem row(s)' ELSE '' END AS message
    FROM counts
    UNION ALL SELECT 'mart_broken', NULL, 'error', 'UNRESOLVED_COLUMN.WITH_SUGGESTION'
    UNION ALL SELECT 'mart_divides', NULL, 'error', 'DIVIDE_BY_ZERO')
"""


@query(f"WITH {_SUITE_SQL} SELECT * FROM results")
def data_test_suite(spark: SparkSession, root: str) -> DataFrame:
    return suite(spark, root)


@query(f"""
WITH {_SUITE_SQL}
SELECT COUNT(*) AS tests, COUNT(*) FILTER (WHERE status = 'passed') AS passed,
       COUNT(*) FILTER (WHERE status IN ('failed', 'error')) AS failing,
       CASE WHEN COUNT(*) FILTER (WHERE status IN ('failed', 'error')) > 0 THEN 1 ELSE 0 END
           AS exit_code
FROM results
""")
def data_test_totals(spark: SparkSession, root: str) -> DataFrame:
    return data_tests.suite_totals(suite(spark, root))


@query(f"""
WITH {_SUITE_SQL}
SELECT string_agg(name, ', ' ORDER BY name) AS failing FROM results
WHERE status IN ('failed', 'error')
""")
def failing_banner(spark: SparkSession, root: str) -> DataFrame:
    return data_tests.failing_names(suite(spark, root))
