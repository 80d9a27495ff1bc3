"""Run history derived from the events: one run per event type and day (or hour)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martwright.functions.values import FAILED, PASSED, WARNING, scaled, total
from martwright.operators import history
from martwright.operators.checks import drop_percent
from martwright.plans import views
from martwright.plans.registry import query
from martwright.session import read_stored, read_table

_RUNS_SQL = """
d AS (
    SELECT event_type AS metric_name, CAST(ts AS DATE) AS day, COUNT(*) AS row_count,
           CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS value_sum
    FROM events GROUP BY 1, 2),
l AS (
    SELECT *, LAG(row_count) OVER (PARTITION BY metric_name ORDER BY day) AS previous FROM d),
p AS (SELECT *, 100.0::DOUBLE * (previous - row_count) / previous AS drop_pct FROM l),
runs AS (
    SELECT metric_name, CAST(day AS TIMESTAMP) AS started_at, row_count, value_sum,
           CASE WHEN drop_pct > 20 THEN 'failed' WHEN drop_pct > 10 THEN 'warning'
                ELSE 'passed' END AS status,
           CASE WHEN isodow(day) >= 6 THEN 'scheduled' ELSE 'cli' END AS triggered_by
    FROM p)
"""


def daily_runs(spark: SparkSession, root: str) -> DataFrame:
    events = views.events(spark, root)
    daily = events.groupBy(
        F.col("event_type").alias("metric_name"), F.col("ts").cast("date").alias("day")
    ).agg(F.count(F.lit(1)).alias("row_count"), total(events, "value").alias("value_sum"))
    # One row per metric and day is left here.
    order = Window.partitionBy("metric_name").orderBy("day")
    dropped = drop_percent(F.col("row_count"), F.lag("row_count").over(order))
    return daily.withColumn("drop_pct", dropped).select(
        "metric_name",
        F.col("day").cast("timestamp_ntz").alias("started_at"),
        "row_count",
        "value_sum",
        F.when(F.col("drop_pct") > 20, FAILED)
        .when(F.col("drop_pct") > 10, WARNING)
        .otherwise(PASSED)
        .alias("status"),
        F.when(F.weekday("day") >= 5, "scheduled").otherwise("cli").alias("triggered_by"),
    )


_RESULTS_SQL = """
results AS (
    SELECT event_type AS metric, 'mean value' AS rule, date_trunc('hour', ts) AS started_at,
           CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) AS mean, COUNT(*) AS n
    FROM events GROUP BY 1, 2, 3),
checked AS (
    SELECT metric, rule, started_at,
           CASE WHEN mean < 37 THEN 'failed' WHEN mean < 43 THEN 'warning' ELSE 'passed' END
               AS status,
           n || ' rows' AS message FROM results),
flagged AS (
    SELECT *, status = 'failed' AS f, status = 'passed' AS p FROM checked),
numbered AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY metric, rule ORDER BY started_at)
            - ROW_NUMBER() OVER (PARTITION BY metric, rule, f ORDER BY started_at) AS fi,
           ROW_NUMBER() OVER (PARTITION BY metric, rule ORDER BY started_at)
            - ROW_NUMBER() OVER (PARTITION BY metric, rule, p ORDER BY started_at) AS pi
    FROM flagged),
failing AS (
    SELECT metric, rule, MIN(started_at) AS streak_start, MAX(started_at) AS streak_end,
           COUNT(*) AS runs, '[trust] ' || metric || ' failed: ' || rule AS title
    FROM numbered WHERE f GROUP BY metric, rule, fi HAVING COUNT(*) >= 3),
passing AS (
    SELECT metric, rule, MIN(started_at) AS streak_start
    FROM numbered WHERE p GROUP BY metric, rule, pi HAVING COUNT(*) >= 3)
"""


def hourly_results(spark: SparkSession, root: str) -> DataFrame:
    events = views.events(spark, root)
    mean = total(events, "value") / F.count(F.lit(1))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    measured = events.groupBy(
        F.col("event_type").alias("metric"),
        F.lit("mean value").alias("rule"),
        hour.alias("started_at"),
    ).agg(mean.alias("mean"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("mean") < 37, FAILED).when(F.col("mean") < 43, WARNING).otherwise(PASSED)
    return measured.select(
        "metric",
        "rule",
        "started_at",
        status.alias("status"),
        F.format_string("%d rows", "n").alias("message"),
    )


def _by_day() -> Column:
    """Hourly runs of one rule are split by day."""
    return F.col("started_at").cast("date")


@query("""
SELECT 'event value' AS metric_name, TIMESTAMP '2024-01-31 00:00:00' AS started_at,
       COUNT(*) AS row_count, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value_sum,
       sha256('event_id:bigint,event_type:string,props:string,ts:timestamp_ntz,user_id:bigint,value:double')
           AS schema_fingerprint,
       '{"value":"'
           || printf('%.4f', CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / COUNT(value))
           || '","user_id":"' || printf('%.4f', SUM(user_id)::DOUBLE / COUNT(user_id))
           || '"}' AS column_means_json
FROM events
""")
def run_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The fingerprint is that of the files as they are."""
    events = scaled(read_stored(spark, root, "events"), "value", 2)
    return history.run_snapshot(
        events, "event value", "value", ["value", "user_id"], views.EVENTS_AS_OF
    )


@query(f"""
WITH {_RUNS_SQL}
SELECT metric_name, started_at, status,
       CASE status WHEN 'passed' THEN 'pass' WHEN 'warning' THEN 'warn' ELSE 'fail' END
           AS short_status,
       CASE WHEN started_at < TIMESTAMP '2024-01-24' THEN 'grey' WHEN status = 'failed' THEN 'red'
            WHEN status = 'warning' THEN 'yellow' ELSE 'green' END AS light
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric_name ORDER BY started_at DESC) AS rn
      FROM runs) WHERE rn = 1
""")
def latest_run_status(spark: SparkSession, root: str) -> DataFrame:
    return history.latest_status(daily_runs(spark, root), views.EVENTS_AS_OF)


@query(f"""
WITH {_RUNS_SQL},
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY metric_name ORDER BY started_at DESC) AS rn FROM runs)
SELECT metric_name, started_at, row_count, value_sum, status, triggered_by,
       CAST(ROW_NUMBER() OVER (PARTITION BY metric_name ORDER BY started_at) AS INTEGER) AS position
FROM n WHERE rn <= 5
""")
def history_last_n(spark: SparkSession, root: str) -> DataFrame:
    return history.last_runs(daily_runs(spark, root), 5)


@query(f"""
WITH {_RUNS_SQL}
SELECT metric_name, MAX(started_at) AS started_at, max_by(row_count, started_at) AS row_count,
       max_by(value_sum, started_at) AS value_sum, max_by(status, started_at) AS status,
       max_by(triggered_by, started_at) AS triggered_by
FROM runs WHERE started_at <= TIMESTAMP '2024-01-24' GROUP BY 1
""")
def baseline_run(spark: SparkSession, root: str) -> DataFrame:
    """The run a week-over-week rule compares with."""
    return history.previous_period_run(daily_runs(spark, root), views.EVENTS_AS_OF, 7)


@query(f"""
WITH {_RUNS_SQL}
SELECT triggered_by, status, COUNT(*) AS runs FROM runs GROUP BY 1, 2
""")
def run_status_counts(spark: SparkSession, root: str) -> DataFrame:
    return history.run_status_counts(daily_runs(spark, root))


@query(f"""
WITH {_RESULTS_SQL}
SELECT *, substr(sha1('trust-regression::' || title), 1, 12) AS dedup_key FROM failing
""")
def failing_streak_issues(spark: SparkSession, root: str) -> DataFrame:
    return history.failing_streaks(hourly_results(spark, root), _by_day())


@query(f"""
WITH {_RESULTS_SQL},
last AS (SELECT metric, rule, MAX(streak_end) AS failed_until FROM failing GROUP BY 1, 2)
SELECT metric, rule, MIN(failed_until) AS failed_until, MIN(streak_start) AS recovered_from
FROM passing JOIN last USING (metric, rule) WHERE streak_start > failed_until GROUP BY 1, 2
""")
def recovered_streaks(spark: SparkSession, root: str) -> DataFrame:
    return history.recovered_streaks(hourly_results(spark, root), _by_day())


@query(f"""
WITH {_RESULTS_SQL},
recent AS (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY metric, rule ORDER BY started_at DESC) AS rn
    FROM checked),
lines AS (
    SELECT metric, rule,
           string_agg('- ' || strftime(started_at, '%Y-%m-%d %H:%M:%S') || ': ' || status || ' ('
                      || message || ')', chr(10) ORDER BY started_at) AS recent_history
    FROM recent WHERE rn <= 5 GROUP BY 1, 2)
SELECT f.metric, f.rule, title, substr(sha1('trust-regression::' || title), 1, 12) AS dedup_key,
       COUNT(*) AS streaks, MAX(runs) AS longest, recent_history
FROM failing f JOIN lines l ON l.metric = f.metric AND l.rule = f.rule
GROUP BY 1, 2, 3, 4, recent_history
""")
def issue_drafts(spark: SparkSession, root: str) -> DataFrame:
    return history.issue_drafts(hourly_results(spark, root), _by_day())


@query("""
WITH c AS (SELECT source, doc_id, lang, text,
                  LAG(text) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM documents),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id DESC) AS position
      FROM c WHERE before IS NULL OR before <> text)
SELECT source, doc_id, lang, CAST(position AS INTEGER) AS position FROM k WHERE position <= 30
""")
def revision_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Each source is a contract, its documents in order are the revisions of its text."""
    revisions = read_table(spark, root, "documents").select(
        "source", "doc_id", "lang", F.sha2("text", 256).alias("digest")
    )
    chunks = [F.floor(F.col("doc_id") / width) for width in (2**12, 2**24, 2**36)]
    latest = history.latest_revisions(revisions, ["source"], "doc_id", "digest", chunks, 30)
    return latest.drop("digest")


@query("""
WITH t AS (
    SELECT 'events' AS table_name, MAX(ts) AS newest FROM events
    UNION ALL SELECT 'orders', MAX(o_orderdate) FROM orders
    UNION ALL SELECT 'lineitem', MAX(l_shipdate) FROM lineitem
    UNION ALL SELECT 'orphan_lines', MAX(l_shipdate) FROM lineitem
              WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
SELECT MIN(newest) AS data_through, min_by(table_name, newest) AS oldest_table,
       COUNT(*) AS tables
FROM t WHERE newest IS NOT NULL
""")
def freshness_header(spark: SparkSession, root: str) -> DataFrame:
    """Lines without an order are a table too, an empty one, and so left out."""
    orders, lineitem = (read_table(spark, root, t) for t in ("orders", "lineitem"))
    return history.freshness_header(
        {
            "events": (views.events(spark, root), "ts"),
            "orders": (orders, "o_orderdate"),
            "lineitem": (lineitem, "l_shipdate"),
            "orphan_lines": (
                lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"], "left_anti"),
                "l_shipdate",
            ),
        }
    )


@query("""
SELECT doc_id AS metric, lang AS owner, source FROM documents
WHERE contains(lower(text), 'the') AND lang = 'en' AND doc_id > 100
ORDER BY doc_id LIMIT 20
""")
def catalog_search(spark: SparkSession, root: str) -> DataFrame:
    """A further page of the English documents that mention a word; whole texts are searched."""
    catalog = read_table(spark, root, "documents").select(
        F.col("doc_id").alias("metric"), F.col("lang").alias("owner"), "source", "text"
    )
    found = history.catalog_search(catalog, ["text"], "the", {"owner": "en"}, after=100)
    return found.select("metric", "owner", "source")
