"""Lineage as an edge table: upsert, bounded upstream walk, stub edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how far an upstream walk goes.
MAX_HOPS = 3


def dealt(rows: DataFrame, tasks: int | None, *columns: str) -> DataFrame:
    """``rows`` dealt by ``columns`` over that many tasks, which adaptive execution does not merge again."""
    return rows if tasks is None else rows.repartition(tasks, *columns)


def upsert_edges(*seen: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per (upstream, downstream, edge_type): first discovered, last seen.

    With ``tasks`` the edges are dealt out before they are grouped, so that a task groups as many as it gets.
    """
    key = ["upstream", "downstream", "edge_type"]
    edges = dealt(reduce(DataFrame.unionByName, seen), tasks, *key)
    return edges.groupBy(*key).agg(
        F.min("discovered_at").alias("discovered_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def upstream(
    metrics: DataFrame, edges: DataFrame, hops: int = MAX_HOPS, tasks: int | None = None
) -> DataFrame:
    """Ancestors of each metric with the least number of hops, at most ``hops``.

    One growing set: each step joins it with the edges once, keeping what it has and adding what
    lies one hop further, and reduces it to the least hops per node, so that a node
    reached over many paths is expanded once. With ``tasks`` the edges are dealt over that many for each join.
    """
    links = dealt(edges.select("upstream", "downstream"), tasks, "downstream")
    reached = (
        metrics.select("metric", F.col("metric").alias("node"), F.lit(0).alias("hops"))
        .distinct()
    )
    for _ in range(hops):
        here = F.struct(F.col("node"), F.col("hops"))
        further = F.struct(F.col("upstream").alias("node"), (F.col("hops") + 1).alias("hops"))
        both = F.when(F.col("upstream").isNull(), F.array(here)).otherwise(F.array(here, further))
        reached = (
            reached.join(links, F.col("node") == F.col("downstream"), "left")
            .select("metric", F.inline(both))
            .groupBy("metric", "node")
            .agg(F.min("hops").alias("hops"))
        )
    return reached.filter(F.col("node") != F.col("metric"))


def replace_subgraph(stored: DataFrame, metric: str, seen: DataFrame) -> DataFrame:
    """The edge table after a metric was read anew: its edges that are gone upstream go.

    ``seen`` holds all edges that lead to the metric now; first discoveries are kept.
    """
    before = stored.filter(F.col("downstream") == metric)
    key = ["upstream", "downstream", "edge_type"]
    still = before.join(seen.select(*key), key, "left_semi")
    return stored.filter(F.col("downstream") != metric).unionByName(upsert_edges(still, seen))


def node_kind(kind: Column) -> Column:
    """Display kind: source, metric and transform stay; model and anything else is transform."""
    return F.when(kind.isin("source", "metric", "transform"), kind).otherwise("transform")


def with_stub(metrics: DataFrame, edges: DataFrame, walk: DataFrame) -> DataFrame:
    """Add a source one hop up for each metric that no edge leads to.

    ``metrics`` holds (metric, primary_table).
    """
    led = edges.select(F.col("downstream").alias("metric"))
    # Reduced to the few metrics first: the whole edge table is neither sorted nor sent anywhere.
    led = led.join(metrics.select("metric"), "metric", "left_semi").distinct()
    bare = metrics.join(led, "metric", "left_anti")
    stubs = bare.select("metric", F.col("primary_table").alias("node"), F.lit(1).alias("hops"))
    return walk.unionByName(stubs)
