"""Difference of two large tables by a tree of digests.

Every row is digested and falls into a leaf by a hash of its key. A leaf's digest is the count and the sums of its
rows' digests, which no order of rows changes; a node above adds up its children. Two tables are compared from
the root down: below a node that is equal nothing is looked at. Only the rows of differing leaves are then
compared key by key. The digests of a table are a small table themselves, which may be stored
beside it or sent in its place.

A table stored in folders by a hash of its key (``load`` with ``buckets``) is read a second time
only in the folders that hold a differing leaf.

Defined results: missing values equal each other and nothing else; rows that share a key are compared
as a bag; columns that only one side has are differences of the schema and raise; columns without a hash in
Spark (maps) are to be cast first; the order of columns does not count; empty tables have no leaves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.session import cut_lineage
from martwright.sources.load import BUCKET, SchemaMismatch, bucket_of, folder_bytes

SUMS = ("n", "a_low", "a_high", "b_low", "b_high")


def _halves(digest: Column, name: str) -> list[Column]:
    """Sums of the two halves of a 64-bit digest, which 2^31 rows cannot overflow."""
    return [
        F.sum(digest.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_low"),
        F.sum(F.shiftrightunsigned(digest, 32)).alias(f"{name}_high"),
    ]


def _digest(columns: list[str], seed: int) -> Column:
    """A missing value leaves a hash as it was, so whether it is missing is hashed too."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def _sums(columns: list[str]) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        *_halves(_digest(columns, 11), "a"),
        *_halves(_digest(columns, 29), "b"),
    ]


def leaf_digests(table: DataFrame, keys: list[str], leaves: int = 4096) -> DataFrame:
    """(leaf, n, sums) of a table: one row per leaf, summed in the map tasks first."""
    columns = sorted(set(table.columns) - {BUCKET})
    return table.groupBy(bucket_of(keys, leaves).alias("leaf")).agg(*_sums(columns))


def level(digests: DataFrame, nodes: int) -> DataFrame:
    """The digests of a level with ``nodes`` nodes: a leaf lies below node ``leaf % nodes``."""
    node = F.col("leaf") % F.lit(nodes)
    return digests.groupBy(node.alias("node")).agg(*[F.sum(s).alias(s) for s in SUMS])


def differing_leaves(left: DataFrame, right: DataFrame, leaves: int = 4096, fan: int = 16) -> list[int]:
    """Numbers of the leaves whose digests differ, found from the root down.

    Each step compares the children of the nodes that differ; ``leaves`` is a power of ``fan``. At most
    ``leaves`` numbers reach the driver.
    """
    nodes, below = 1, None
    while True:
        sides = []
        for side, mark in ((left, "l"), (right, "r")):
            if below is not None:
                side = side.where((F.col("leaf") % F.lit(nodes // fan)).isin(below))
            sides.append(level(side, nodes).select("node", F.struct(*SUMS).alias(mark)))
        unequal = sides[0].join(sides[1], "node", "full_outer").where(~F.col("l").eqNullSafe(F.col("r")))
        below = sorted(r["node"] for r in unequal.select("node").collect())
        if not below or nodes >= leaves:
            return below
        nodes *= fan


def _by_key(table: DataFrame, keys: list[str], columns: list[str], side: str) -> DataFrame:
    """A row per key: its bag's digest and a digest of every column."""
    per_column = [F.bit_xor(F.xxhash64(F.col(c).isNull(), F.col(c))).alias(c) for c in columns]
    sums = table.groupBy(*keys).agg(*_sums([*keys, *columns]), F.struct(*per_column).alias("columns"))
    return sums.select(
        *[F.col(k).alias(f"{side}_{k}") for k in keys],
        F.struct(*SUMS).alias(f"{side}_sums"),
        F.col("n").alias(f"{side}_rows"),
        F.col("columns").alias(f"{side}_columns"),
    )


def compare_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that differ: keys, side (left only, right only, changed), rows of both sides, changed columns.

    Rows that share a key are one row before the join. ``columns`` names the changed columns where
    both sides have one row, else it is empty.
    """
    columns = sorted(set(left.columns) - {*keys, BUCKET})
    sides = [_by_key(t, keys, columns, s) for t, s in ((left, "l"), (right, "r"))]
    same = reduce(lambda a, b: a & b, [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys])
    met = sides[0].join(sides[1], same, "full_outer")
    single = (F.col("l_rows") == 1) & (F.col("r_rows") == 1)
    changed = [
        F.when(single & (F.col(f"l_columns.{c}") != F.col(f"r_columns.{c}")), c) for c in columns
    ]
    side = (
        F.when(F.col("r_rows").isNull(), "left only")
        .when(F.col("l_rows").isNull(), "right only")
        .otherwise("changed")
    )
    return met.where(~F.col("l_sums").eqNullSafe(F.col("r_sums"))).select(
        *[F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in keys],
        side.alias("side"),
        F.coalesce("l_rows", F.lit(0)).alias("left_rows"),
        F.coalesce("r_rows", F.lit(0)).alias("right_rows"),
        F.array_compact(F.array(*changed)).alias("columns"),
    )


@dataclass(frozen=True)
class Difference:
    """``rows`` as in ``compare_keys``; of ``bytes_stored`` the second read took ``bytes_read``, if known."""

    rows: DataFrame
    leaves: list[int]
    bytes_stored: int | None = None
    bytes_read: int | None = None


def _guard(left: DataFrame, right: DataFrame) -> None:
    one, two = ({f.name: f.dataType.simpleString() for f in t.schema.fields if f.name != BUCKET} for t in (left, right))
    if one != two:
        odd = sorted({*one.items()} ^ {*two.items()})
        raise SchemaMismatch("the tables differ in " + ", ".join(f"{c} {t}" for c, t in odd))


def difference(
    left: DataFrame, right: DataFrame, keys: list[str], leaves: int = 4096, fan: int = 16
) -> Difference:
    """Keys at which two tables differ."""
    _guard(left, right)
    digests = [cut_lineage(leaf_digests(t, keys, leaves)) for t in (left, right)]
    found = differing_leaves(*digests, leaves, fan)
    rows = [t.where(bucket_of(keys, leaves).isin(found)) for t in (left, right)]
    return Difference(compare_keys(*rows, keys), found)


def stored_difference(
    spark: SparkSession, left: str, right: str, keys: list[str], buckets: int, leaves: int = 4096, fan: int = 16
) -> Difference:
    """Of two tables stored with ``buckets`` folders, a divisor of ``leaves``; see ``difference``.

    A leaf lies in the folder ``leaf % buckets``, so the second read names its folders.
    """
    if leaves % buckets:
        raise ValueError("leaves must be a multiple of buckets")
    whole = difference(spark.read.parquet(left), spark.read.parquet(right), keys, leaves, fan)
    folders = sorted({leaf % buckets for leaf in whole.leaves})
    rows = [
        spark.read.parquet(p).where(F.col(BUCKET).isin(folders) & bucket_of(keys, leaves).isin(whole.leaves))
        for p in (left, right)
    ]
    sizes = [folder_bytes(spark, p) for p in (left, right)]
    return Difference(
        compare_keys(*rows, keys),
        whole.leaves,
        sum(sum(s.values()) for s in sizes),
        sum(s.get(f, 0) for s in sizes for f in folders),
    )
