"""Mixing sources to target weights.

Every row gets a hash-random key. A source's rows are sorted by that key in slices of the key
range; slice totals give each slice its offset, so the running total of words over a whole
source needs no task that holds the source. The order is cut where the running total reaches
the source's budget; a budget above the source's size takes whole epochs first.

Defined results: null texts have size 0; a null source is a source of its own, last in
order; repeated rows are taken row by row; the targets of all sources are worked out in one task, which
some millions of sources fit; an empty table gives an empty table. Other columns
of the input, whatever their names, are left out of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
# Sources whose targets are sent to every task: some 100 bytes each.
BROADCAST_SOURCES = 20_000


def sizes(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    totals: DataFrame, *, weights: Sequence[float], share: float, limit: float
) -> DataFrame:
    """Targets per source; ``totals`` has one row (source, source_size, n_rows) per source.

    The budget (``share`` of all words) is split by weight; a target stops at ``limit`` times
    its source's size and what it leaves is split among the others by weight. That ends at
    ``min(cap, level * weight)`` for the one level that spends the budget: with sources
    in the order of cap over weight, the first ``level`` not above its own source's ratio,
    which is the greatest such level.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", "source_key")
    done = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(
        F.array(*(F.lit(float(w)) for w in weights)),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    ranked = (
        totals.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(
        F.sum("cap").over(done), F.lit(0.0)
    )
    open_weight = F.sum("weight").over(everything) - F.coalesce(
        F.sum("weight").over(done), F.lit(0.0)
    )
    level = ranked.withColumn("level", left / open_weight).withColumn(
        "water",
        F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything),
    )
    return level.withColumn(
        "target", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap")))
    ).select("source_key", "source_size", "n_rows", "target")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: Sequence[Column] = (),
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 42,
    rows_per_slice: int = 4096,
) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target and taken words.

    ``carry`` are further columns of ``docs`` to keep. The last document a source
    gives is cut at the budget, so the words taken add up to the rounded target.
    """
    text, source = F.col(text_col), F.col(source_col)
    digest = F.md5(
        F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), source, text)
    )
    base = cut_lineage(
        docs.select(
            F.col(id_col).alias("id"),
            F.struct(F.lit(0).alias("_"), *carry).alias("carried"),
            source.alias("source"),
            F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")).alias(
                "source_key"
            ),
            sizes(text).alias("size"),
            F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("draw"),
            F.conv(F.substring(digest, 16, 15), 16, 10).cast("long").alias("tie"),
        )
    )
    totals = base.groupBy("source_key").agg(
        F.first("source").alias("source"),
        F.sum("size").alias("source_size"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    # Written first, so that its size is known: few sources go to every task. Many are joined
    # by source and dealt out again by slice, so that no source stays in one task.
    targets = cut_lineage(source_targets(totals, weights=weights, share=share, limit=limit))
    few = targets.count() <= BROADCAST_SOURCES
    n_slices = F.ceil(F.col("n_rows") / F.lit(rows_per_slice))
    part = F.least(F.floor(F.col("draw") / F.lit(float(16**15)) * n_slices), n_slices - 1)
    rows = base.join(F.broadcast(targets) if few else targets, "source_key").withColumn("slice", part)
    if not few:
        rows = rows.repartition("source_key", "slice")
    ahead = Window.partitionBy("source_key").orderBy("slice")
    # Written first: planned with the window below, both would be dealt by source alone.
    offsets = cut_lineage(
        rows.groupBy("source_key", "slice")
        .agg(F.sum("size").alias("slice_size"))
        .withColumn(
            "offset",
            F.coalesce(
                F.sum("slice_size").over(ahead.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("source_key", "slice", "offset")
    )
    inside = (
        Window.partitionBy("source_key", "slice")
        .orderBy("draw", "tie", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("long")
    epochs = F.when(
        F.col("source_size") > 0, F.floor(budget / F.col("source_size"))
    ).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(
        F.lit(0), F.least(F.col("size"), rest - F.col("before"))
    )
    return (
        rows.join(offsets, ["source_key", "slice"])
        .withColumn("before", before)
        .select(
            F.col("id").alias(id_col),
            "size",
            "source_size",
            "target",
            taken.cast("long").alias("taken"),
            "carried.*",
        )
        .drop("_")
    )
