"""Joins whose large side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What one task should get of a key at most.
ROWS_PER_SALT = 1_000_000


def salted_join(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread: Column,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Inner join that spreads a key of ``large`` over more tasks the more rows it has.

    Only keys with more than ``rows_per_salt`` rows get salts, and only their rows of ``small``, which
    holds few per key, are repeated. There are at most rows / ``rows_per_salt`` such keys, so they are
    broadcast. ``spread`` is a value of the row, so a lost task is rebuilt with the same salts.
    """
    heavy = F.broadcast(
        large.groupBy(*keys)
        .agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_salt)).cast("int").alias("_salts"))
        .filter(F.col("_salts") > 1)
    )
    salts = F.coalesce("_salts", F.lit(1))
    salt = F.pmod(F.xxhash64(spread), salts).cast("int")
    salted = large.join(heavy, keys, "left").withColumn("_salt", salt).drop("_salts")
    repeated = (
        small.join(heavy, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return salted.join(repeated, [*keys, "_salt"]).drop("_salt")
