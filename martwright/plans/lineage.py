"""Lineage edges derived from the foreign keys of the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.operators import lineage
from martwright.plans.registry import query
from martwright.session import cut_lineage, read_table

_STAMP = "TIMESTAMP '2001-08-01 00:00:00'"

_EDGES_SQL = f"""
seen AS (
    SELECT 'source://supplier/' || l_suppkey AS upstream, 'model://part/' || l_partkey AS downstream,
           'derives_from' AS edge_type, l_shipdate AS seen_at FROM lineitem
    UNION ALL SELECT 'model://part/' || p_partkey, 'metric://' || p_brand, 'derives_from', {_STAMP}
              FROM part
    UNION ALL SELECT 'source://nation/' || s_nationkey, 'source://supplier/' || s_suppkey,
              'references', {_STAMP} FROM supplier
    UNION ALL SELECT 'source://region/' || n_regionkey, 'source://nation/' || n_nationkey,
              'references', {_STAMP} FROM nation),
edges AS (
    SELECT upstream, downstream, edge_type, MIN(seen_at) AS discovered_at, MAX(seen_at) AS last_seen_at
    FROM seen GROUP BY 1, 2, 3)
"""


# Rows that one task should group or sort: about 200 MB as edges.
ROWS_PER_TASK = 500_000


def edge_tasks(spark: SparkSession, root: str, rows_per_task: int = ROWS_PER_TASK) -> int | None:
    """How many tasks the edges are dealt over: more with more rows; the bare count reads no columns.

    None where the tasks that run at once hold them all: adaptive execution may choose then.
    """
    tables = (read_table(spark, root, t).select() for t in ("lineitem", "part", "supplier"))
    rows = reduce(DataFrame.union, tables).count()
    tasks = -(-rows // rows_per_task)
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def _urn(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def edges(spark: SparkSession, root: str, tasks: int | None) -> DataFrame:
    """Supplier to part to brand, and nation and region above the supplier.

    Line items are reduced on their integer keys; names are built from the edges left. As these may be
    almost as many, both steps are dealt over ``tasks`` tasks: what a task holds does not grow with the table.
    """
    stamp = F.expr("TIMESTAMP_NTZ'2001-08-01 00:00:00'")
    lines = (
        lineage.dealt(read_table(spark, root, "lineitem"), tasks, "l_suppkey", "l_partkey")
        .groupBy("l_suppkey", "l_partkey")
        .agg(F.min("l_shipdate").alias("discovered_at"), F.max("l_shipdate").alias("last_seen_at"))
    )

    def named(rows: DataFrame, up: Column, down: Column, kind: str, *at: Column | str) -> DataFrame:
        first, last = at or (stamp, stamp)
        return rows.select(
            up.alias("upstream"),
            down.alias("downstream"),
            F.lit(kind).alias("edge_type"),
            (F.col(first) if isinstance(first, str) else first).alias("discovered_at"),
            (F.col(last) if isinstance(last, str) else last).alias("last_seen_at"),
        )

    return lineage.upsert_edges(
        named(
            lines,
            _urn("source://supplier/", "l_suppkey"),
            _urn("model://part/", "l_partkey"),
            "derives_from",
            "discovered_at",
            "last_seen_at",
        ),
        named(
            read_table(spark, root, "part"),
            _urn("model://part/", "p_partkey"),
            _urn("metric://", "p_brand"),
            "derives_from",
        ),
        named(
            read_table(spark, root, "supplier"),
            _urn("source://nation/", "s_nationkey"),
            _urn("source://supplier/", "s_suppkey"),
            "references",
        ),
        named(
            read_table(spark, root, "nation"),
            _urn("source://region/", "n_regionkey"),
            _urn("source://nation/", "n_nationkey"),
            "references",
        ),
        tasks=tasks,
    )


@query(f"WITH {_EDGES_SQL} SELECT * FROM edges")
def lineage_edges(spark: SparkSession, root: str) -> DataFrame:
    return edges(spark, root, edge_tasks(spark, root))


def _metrics(spark: SparkSession, root: str) -> DataFrame:
    """One metric per brand, and one per part type, which no edge leads to."""
    part = read_table(spark, root, "part")
    names = [part.select(_urn("metric://", c).alias("metric")) for c in ("p_brand", "p_type")]
    return (
        reduce(DataFrame.unionByName, names)
        .distinct()
        .withColumn("primary_table", F.lit("source://part"))
    )


@query(f"""
WITH {_EDGES_SQL},
m AS (SELECT DISTINCT 'metric://' || p_brand AS metric FROM part
      UNION SELECT DISTINCT 'metric://' || p_type FROM part),
h1 AS (SELECT DISTINCT m.metric, e.upstream AS node FROM m JOIN edges e ON e.downstream = m.metric),
h2 AS (SELECT DISTINCT h1.metric, e.upstream AS node FROM h1 JOIN edges e ON e.downstream = h1.node),
h3 AS (SELECT DISTINCT h2.metric, e.upstream AS node FROM h2 JOIN edges e ON e.downstream = h2.node),
walk AS (SELECT metric, node, MIN(hops) AS hops FROM (
             SELECT *, 1 AS hops FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3)
         GROUP BY 1, 2),
all_nodes AS (
    SELECT * FROM walk
    UNION ALL SELECT metric, 'source://part', 1 FROM m
              WHERE metric NOT IN (SELECT metric FROM walk))
SELECT metric, node, hops,
       CASE split_part(node, '://', 1) WHEN 'source' THEN 'source' ELSE 'transform' END AS kind
FROM all_nodes
""")
def lineage_upstream(spark: SparkSession, root: str) -> DataFrame:
    metrics = _metrics(spark, root)
    # Read by every hop: made once, as an edge table is kept.
    tasks = edge_tasks(spark, root)
    links = cut_lineage(edges(spark, root, tasks))
    whole = lineage.with_stub(metrics, links, lineage.upstream(metrics, links, tasks=tasks))
    return whole.withColumn("kind", lineage.node_kind(F.split_part("node", F.lit("://"), F.lit(1))))
