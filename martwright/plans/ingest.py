"""Ingest modes over the given tables, written to a scratch folder and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.plans import views
from martwright.plans.registry import query
from martwright.plans.semantic import ENTITIES
from martwright.session import read_table, scratch_dir
from martwright.sources import inventory
from martwright.sources.files import stamp_loaded
from martwright.sources.load import last_days, load, run_ingest, stored_rows
from martwright.sources.once import append_once, loaded_rows
from martwright.sources.rejects import load_with_rejects, rejected_lines

FIRST = datetime(2024, 1, 31, 0, 0, 0)
SECOND = datetime(2024, 1, 31, 12, 0, 0)

EVENT_COLUMNS = [
    {"name": "event_id", "type": "BIGINT"},
    {"name": "ts", "type": "TIMESTAMP"},
    {"name": "user_id", "type": "BIGINT"},
    {"name": "event_type", "type": "VARCHAR"},
    {"name": "value", "type": "DOUBLE"},
    {"name": "props", "type": "VARCHAR"},
]


def _spec(path: str, mode: str, **source) -> dict:
    return {
        "source": {"type": "csv", "path": path, "glob": "*.csv", **source},
        "target": {"table": "raw_events", "mode": mode},
        "columns": EVENT_COLUMNS,
    }


def _events_csv(spark: SparkSession, root: str, folder: str) -> str:
    path = f"{folder}/events"
    _write_csv(views.events(spark, root), path)
    return path


def _as_text(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _write_csv(events: DataFrame, path: str) -> None:
    _as_text(events).write.option("header", True).option("escape", '"').csv(path)


@query("SELECT *, TIMESTAMP '2024-01-31 12:00:00' AS _loaded_at FROM events")
def ingest_replace(spark: SparkSession, root: str) -> DataFrame:
    """Loading twice leaves the rows of the second load only."""
    folder = scratch_dir(spark, "ingest_replace")
    spec = _spec(_events_csv(spark, root, folder), "replace")
    run_ingest(spark, spec, folder, FIRST)
    run_ingest(spark, spec, folder, SECOND)
    return spark.read.parquet(f"{folder}/raw_events")


@query("""
SELECT *, TIMESTAMP '2024-01-31 00:00:00' AS _loaded_at FROM events
UNION ALL SELECT *, TIMESTAMP '2024-01-31 12:00:00' FROM events
""")
def ingest_append(spark: SparkSession, root: str) -> DataFrame:
    """Loading twice adds every row twice."""
    folder = scratch_dir(spark, "ingest_append")
    spec = _spec(_events_csv(spark, root, folder), "append")
    run_ingest(spark, spec, folder, FIRST)
    run_ingest(spark, spec, folder, SECOND)
    return spark.read.parquet(f"{folder}/raw_events")


@query("""
SELECT *, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-31 00:00:00'
               ELSE TIMESTAMP '2024-01-31 12:00:00' END AS _loaded_at FROM events
""")
def ingest_once(spark: SparkSession, root: str) -> DataFrame:
    """Three runs over a source that gets new files before the last one: every file counts once."""
    folder = scratch_dir(spark, "ingest_once")
    spec = _spec(f"{folder}/events/*", "append")
    for part, runs in ((0, (FIRST, SECOND)), (1, (SECOND,))):
        rows = views.events(spark, root).filter(F.col("event_id") % 2 == part)
        _write_csv(rows, f"{folder}/events/part{part}")
        for at in runs:
            append_once(spark, spec, folder, at)
    return loaded_rows(spark, f"{folder}/raw_events")


@query("""
SELECT event_id, event_id % 50 NOT IN (7, 13, 21) AS loaded,
       CASE event_id % 50 WHEN 7 THEN 'value: ''n/a'' is not double' WHEN 13 THEN 'number of fields'
            WHEN 21 THEN 'number of fields' END AS reason
FROM events
""")
def ingest_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Event lines of which some hold a word for a number, too few or too many fields."""
    folder = scratch_dir(spark, "ingest_rejects")
    kind = F.col("event_id") % 50
    rows = _as_text(views.events(spark, root)).withColumn(
        "value", F.when(kind == 7, "n/a").otherwise(F.col("value").cast("string"))
    )
    whole = F.to_csv(F.struct(*rows.columns), {"escape": '"'})
    line = F.when(kind == 13, F.concat_ws(",", "event_id", "ts")).when(
        kind == 21, F.concat(whole, F.lit(",more"))
    )
    # One column whose name is the header and whose values are whole lines, written as they are.
    rows.select(line.otherwise(whole).alias(",".join(rows.columns))).write.option(
        "header", True
    ).option("quote", "").option("sep", "\u0001").option("escape", "\u0002").csv(f"{folder}/events")
    load_with_rejects(spark, _spec(f"{folder}/events", "append"), folder, FIRST, max_rate=0.2)
    path = f"{folder}/raw_events"
    loaded = spark.read.parquet(path).select(
        "event_id", F.lit(True).alias("loaded"), F.lit(None).cast("string").alias("reason")
    )
    rejected = rejected_lines(spark, path).select(
        F.split("line", ",", 2)[0].cast("bigint").alias("event_id"), F.lit(False).alias("loaded"), "reason"
    )
    return loaded.unionByName(rejected)


_TIES = [
    "l_shipdate",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
]


@query(f"""
WITH loads AS (
    SELECT *, TIMESTAMP '2024-01-31 00:00:00' AS _loaded_at FROM lineitem WHERE l_linestatus = 'F'
    UNION ALL
    SELECT *, TIMESTAMP '2024-01-31 12:00:00' FROM lineitem WHERE l_linestatus <> 'F')
SELECT * EXCLUDE (rn) FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
                                 ORDER BY _loaded_at DESC, {', '.join(c + ' DESC' for c in _TIES)})
               AS rn
    FROM loads) WHERE rn = 1
""")
def ingest_merge(spark: SparkSession, root: str) -> DataFrame:
    """Two batches of line items, whose key repeats within and across the batches."""
    path = f"{scratch_dir(spark, 'ingest_merge')}/raw_lines"
    lines = read_table(spark, root, "lineitem")
    batches = ((FIRST, F.col("l_linestatus") == "F"), (SECOND, F.col("l_linestatus") != "F"))
    for at, held in batches:
        load(
            stamp_loaded(lines.filter(held), at),
            path,
            "merge",
            primary_key=["l_orderkey", "l_linenumber"],
            newest=_TIES,
            buckets=8,
        )
    return stored_rows(spark, path)


@query("""
SELECT *, TIMESTAMP '2024-01-31 00:00:00' AS _loaded_at FROM events
WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'
""")
def ingest_last_7_days(spark: SparkSession, root: str) -> DataFrame:
    path = f"{scratch_dir(spark, 'ingest_last_7_days')}/raw_events"
    rows = last_days(views.events(spark, root), "ts", FIRST, 7)
    load(stamp_loaded(rows, FIRST), path, "append")
    return spark.read.parquet(path)


TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

_COUNTS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS n FROM {t}" for t in TABLES
)
_ENTITY_SQL = ", ".join(f"('{e['table']}', '{e['entity']}', '{e['description']}')" for e in ENTITIES)


@query(f"""
WITH c AS ({_COUNTS_SQL} UNION ALL SELECT 'mart_missing', NULL),
e(table_name, entity, description) AS (VALUES {_ENTITY_SQL})
SELECT c.table_name, COALESCE(CAST(n AS VARCHAR), '?') AS row_count,
       COALESCE(entity, '—') AS entity, COALESCE(description, '') AS description
FROM c LEFT JOIN e ON e.table_name = c.table_name
""")
def table_inventory(spark: SparkSession, root: str) -> DataFrame:
    session = inventory.counting_session(spark)
    tables = {t: read_table(session, root, t) for t in TABLES}
    return inventory.table_inventory(session, {**tables, "mart_missing": None}, ENTITIES)


@query("""
SELECT 'orders' AS ingest, 'orders' AS table_name, COUNT(*) AS row_count, 'loaded' AS state FROM orders
UNION ALL SELECT 'web_events', 'events', COUNT(*), 'loaded' FROM events
UNION ALL SELECT 'refunds', 'raw_refunds', NULL, 'missing'
""")
def ingest_health(spark: SparkSession, root: str) -> DataFrame:
    specs = {
        "orders": {"target": {"table": "orders"}},
        "web_events": {"target": {"table": "events"}},
        "refunds": {},
    }
    session = inventory.counting_session(spark)
    return inventory.ingest_health(
        session, specs, {t: read_table(session, root, t) for t in ("orders", "events")}
    )
