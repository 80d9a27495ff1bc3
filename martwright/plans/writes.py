"""Write paths over the given tables: folders of CSV files, SQL transforms, history, row-level rates."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.operators import checks, history, marts, metrics, semantic
from martwright.plans import views
from martwright.plans.history import _RUNS_SQL, daily_runs
from martwright.plans.registry import query
from martwright.session import read_stored, read_table, scratch_dir
from martwright.sources.files import stamp_loaded
from martwright.sources.load import (
    SchemaMismatch,
    load,
    load_folder,
    materialise,
    run_everything,
    transform_sql,
)

AT = datetime(2024, 1, 31)

_DAILY_TEXT = """
SELECT CAST(o_orderdate AS DATE) AS day, n_name AS country, COUNT(*) AS order_count,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS revenue
FROM {orders} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
WHERE o_orderstatus = 'F' GROUP BY 1, 2
"""


@query(_DAILY_TEXT.format(orders="orders", customer="customer", nation="nation"))
def sql_transform(spark: SparkSession, root: str) -> DataFrame:
    """Raw tables loaded by mode, then a mart made from the SQL text of its transform."""
    folder = scratch_dir(spark, "sql_transform")
    for table in ("orders", "customer", "nation"):
        load(stamp_loaded(read_table(spark, root, table), AT), f"{folder}/raw_{table}", "replace")
    names = {t: f"raw_{t}" for t in ("orders", "customer", "nation")}
    mart = transform_sql(spark, _DAILY_TEXT.format(**names), folder)
    materialise(mart, f"{folder}/mart_daily")
    return spark.read.parquet(f"{folder}/mart_daily")


@query("""
SELECT r_name AS region, n_name AS nation, TIMESTAMP '2024-01-31 00:00:00' AS _loaded_at
FROM nation JOIN region ON r_regionkey = n_regionkey
""")
def folder_load(spark: SparkSession, root: str) -> DataFrame:
    """Every CSV of a folder becomes the table of its name."""
    folder = scratch_dir(spark, "folder_load")
    for table in ("nation", "region"):
        read_table(spark, root, table).write.option("header", True).csv(f"{folder}/in/{table}.csv")
    load_folder(spark, f"{folder}/in", folder, AT)
    nation, region = (spark.read.parquet(f"{folder}/{t}") for t in ("nation", "region"))
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("r_name").alias("region"), F.col("n_name").alias("nation"), nation["_loaded_at"]
    )


@query("""
SELECT c_mktsegment AS segment, COUNT(*) AS customers,
       COUNT(*) FILTER (WHERE c_acctbal < 0) AS in_debt
FROM customer GROUP BY 1
""")
def everything_run(spark: SparkSession, root: str) -> DataFrame:
    """All ingests, then all marts: one as SQL text, one as a function that reads it."""
    folder = scratch_dir(spark, "everything_run")
    customers = read_table(spark, root, "customer")
    customers.write.option("header", True).csv(f"{folder}/in/customer")
    spec = {
        "source": {"type": "csv", "path": f"{folder}/in/customer"},
        "target": {"table": "raw_customer", "mode": "replace"},
        "columns": [
            {"name": "c_custkey", "type": "BIGINT"},
            {"name": "c_name", "type": "VARCHAR"},
            {"name": "c_nationkey", "type": "INTEGER"},
            {"name": "c_acctbal", "type": "DOUBLE"},
            {"name": "c_mktsegment", "type": "VARCHAR"},
        ],
    }
    transforms = {
        "mart_a_flagged": "SELECT *, c_acctbal < 0 AS debt FROM raw_customer",
        "mart_b_segments": lambda read, as_of: read("mart_a_flagged")
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(F.count(F.lit(1)).alias("customers"), F.count_if("debt").alias("in_debt")),
    }
    run_everything(spark, {"customer": spec}, transforms, folder, AT)
    return spark.read.parquet(f"{folder}/mart_b_segments")


@query(f"WITH {_RUNS_SQL} SELECT * FROM runs")
def history_append(spark: SparkSession, root: str) -> DataFrame:
    """Runs appended to the stored history in two batches, read back whole."""
    path = f"{scratch_dir(spark, 'history_append')}/runs"
    runs = daily_runs(spark, root)
    early = F.col("started_at") < F.lit(datetime(2024, 1, 15)).cast("timestamp_ntz")
    for batch in (runs.filter(early), runs.filter(~early)):
        history.append_history(batch, path)
    return spark.read.parquet(path).select(*runs.columns)


@query("""
SELECT 'orders' AS table_name, COUNT(*) AS row_count, 'missing o_totalprice; new total' AS refused
FROM orders
""")
def schema_guard(spark: SparkSession, root: str) -> DataFrame:
    """A load with a renamed column is refused and leaves the table as it was."""
    path = f"{scratch_dir(spark, 'schema_guard')}/orders"
    orders = stamp_loaded(read_table(spark, root, "orders"), AT)
    load(orders, path, "append")
    try:
        load(orders.withColumnRenamed("o_totalprice", "total"), path, "append")
        refused = None
    except SchemaMismatch as error:
        refused = str(error).removeprefix(f"{path}: ")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit("orders").alias("table_name"), "row_count", F.lit(refused).alias("refused")
    )


@query("""
WITH rates AS (
    SELECT n_regionkey AS currency, CAST(DATE '1992-01-01' + n_nationkey * 90 AS DATE) AS day,
           CAST(1 + n_nationkey / 100.0 AS DECIMAL(10,4)) AS rate
    FROM nation),
o AS (
    SELECT o_orderkey AS order_id, o_orderkey % 5 AS currency, CAST(o_orderdate AS DATE) AS day,
           CAST(o_totalprice AS DECIMAL(12,2)) AS amount
    FROM orders)
SELECT order_id, CAST(o.currency AS INTEGER) AS currency, o.day,
       CAST(amount AS DOUBLE) AS amount, CAST(rate AS DOUBLE) AS rate,
       CAST(amount * rate AS DOUBLE) AS amount_usd
FROM o ASOF LEFT JOIN rates r ON r.currency = o.currency AND r.day <= o.day
""")
def fx_convert_rows(spark: SparkSession, root: str) -> DataFrame:
    """Every order converted at the rate of its day; regions stand for currencies."""
    rates = read_table(spark, root, "nation").select(
        F.col("n_regionkey").alias("currency"),
        F.date_add(F.lit(date(1992, 1, 1)), F.col("n_nationkey") * 90).alias("rate_day"),
        (1 + F.col("n_nationkey") / F.lit(100.0)).cast("decimal(10,4)").alias("rate"),
    )
    orders = read_table(spark, root, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        (F.col("o_orderkey") % 5).cast("int").alias("currency"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("amount"),
    )
    converted = metrics.convert_at_rate(orders, rates, "currency", "day", "amount")
    doubles = {c: F.col(c).cast("double") for c in ("amount", "rate", "amount_usd")}
    return converted.withColumns(doubles)


@query("""
SELECT 'lines' AS metric, 'row_count' AS rule_type, CAST(NULL AS VARCHAR) AS column_name,
       CASE WHEN COUNT(*) > 10 THEN 'passed' ELSE 'failed' END AS status,
       COUNT(*)::DOUBLE AS actual_value, 10.0::DOUBLE AS threshold
FROM lineitem
UNION ALL
SELECT 'order keys', 'null_rate', 'o_orderkey',
       CASE WHEN 100.0 * COUNT(*) FILTER (WHERE o_orderkey IS NULL) / COUNT(*) < 1
            THEN 'passed' ELSE 'failed' END,
       100.0::DOUBLE * COUNT(*) FILTER (WHERE o_orderkey IS NULL) / COUNT(*), 1.0::DOUBLE
FROM orders
""")
def contract_defaults(spark: SparkSession, root: str) -> DataFrame:
    """A contract without rules gets the project's defaults, one with rules keeps its own."""
    contracts = [
        {"metric": "lines", "table": "lineitem"},
        {
            "metric": "order keys",
            "table": "orders",
            "trust": [{"null_rate": {"column": "o_orderkey", "max": "1%"}}],
        },
    ]
    tables = {t: read_table(spark, root, t) for t in ("lineitem", "orders")}
    found = checks.evaluate(contracts, tables, AT, defaults=[{"row_count": {"min": 10}}])
    return found.drop("message")


_CHARGE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


@query(f"""
WITH c AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, {_CHARGE} / 1000000 AS charge
           FROM lineitem)
SELECT month, COUNT(*) AS row_count, ROUND(SUM(charge), 6) AS charge,
       ROUND(SUM(charge) / COUNT(charge), 9) AS mean
FROM c GROUP BY 1
""")
def small_amounts(spark: SparkSession, root: str) -> DataFrame:
    """Line charges in millions, with all their digits: sums round no row."""
    lines = read_table(spark, root, "lineitem").select(
        "l_shipdate", F.expr(f"{_CHARGE} / 1000000").alias("charge")
    )
    series = checks.per_period(lines, "l_shipdate", "month", "charge")
    return series.select(
        F.col("period").alias("month"),
        "row_count",
        F.round("value", 6).alias("charge"),
        F.round("mean", 9).alias("mean"),
    )


@query(f"""
WITH c AS (SELECT l_shipdate, {_CHARGE} / 1000000 AS charge FROM lineitem)
SELECT 'last_30_days' AS time_window, ROUND(SUM(charge), 6) AS value, COUNT(*) AS row_count FROM c
WHERE l_shipdate >= TIMESTAMP '1999-12-02' AND l_shipdate < TIMESTAMP '2000-01-01'
""")
def small_amounts_window(spark: SparkSession, root: str) -> DataFrame:
    lines = read_table(spark, root, "lineitem").select(
        "l_shipdate", F.expr(f"{_CHARGE} / 1000000").alias("charge")
    )
    found = semantic.metric_in_windows(
        lines, "charge", "l_shipdate", date(2000, 1, 1), ("last_30_days",)
    )
    return found.withColumn("value", F.round("value", 6))


@query("""
SELECT CAST(SUM(big) AS DOUBLE) AS spent, CAST(SUM(big) AS DOUBLE) AS budgeted,
       COUNT(*) AS lines, 0::BIGINT AS overspent_lines
FROM (SELECT CAST(o_totalprice AS DECIMAL(38,2)) * 1000000000 AS big FROM orders)
""")
def large_amounts(spark: SparkSession, root: str) -> DataFrame:
    """Amounts near 10^14 with stated cents: their sum is beyond a bigint of cents."""
    big = F.rint(F.col("o_totalprice") * 100) * F.lit(1e7)
    budget = read_table(spark, root, "orders").select(
        big.alias("spent", metadata=views.CENTS), big.alias("budgeted", metadata=views.CENTS)
    )
    return marts.budget_utilisation(budget)


@query("""
SELECT 'events' AS metric, 2::BIGINT AS run, * FROM (VALUES
    ('props', 'added', NULL, 'string'),
    ('session', 'removed', 'string', NULL),
    ('user_id', 'retyped', 'int', 'bigint')) AS v(column_name, change, old_type, new_type)
WHERE EXISTS (SELECT 1 FROM events)
""")
def stored_schema_drift(spark: SparkSession, root: str) -> DataFrame:
    """Two stored versions of a table, compared by the columns that their files carry."""
    folder = scratch_dir(spark, "stored_schema_drift")
    events = read_stored(spark, root, "events")
    older = (
        events.withColumn("session", F.col("props"))
        .withColumn("user_id", F.col("user_id").cast("int"))
        .drop("props")
    )
    older.write.parquet(f"{folder}/v1.parquet")
    events.write.parquet(f"{folder}/v2.parquet")
    runs = [
        checks.schema_snapshot(read_stored(spark, folder, f"v{run}"), "events", run)
        for run in (1, 2)
    ]
    return checks.schema_drift(runs[0].unionByName(runs[1]))
