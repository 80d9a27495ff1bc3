"""Connected components by alternating stars.

Each round points every node's larger neighbours at its smallest neighbour, then every node and
its smaller neighbours at the smallest of them. The edges end as one star per component whose centre
is its smallest node, and the rounds end as soon as they do: every round is a dozen plans and stages that the
driver keeps track of. Smallest neighbours are found by partial minima and joined back, so
a node with very many neighbours is a hot join key, which adaptive execution splits; no
neighbour list is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (
        down.select("u", "v")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` either has one smaller neighbour and no larger one, or only larger ones.

    Such edges are final: each of the centres is the smallest node of its component.
    """
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(
        edges.select("v", F.lit(0))
    )
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return odd.where("up > 1 or (up > 0 and least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the component's smallest node.

    Self loops and repeated or reversed edges do no harm; no edges give no rows.
    """
    now = cut_lineage(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    while not _all_stars(now):
        now = cut_lineage(_small_star(_large_star(now)))
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return cut_lineage(stars.union(stars.select(F.col("root").alias("node"), "root").distinct()))
