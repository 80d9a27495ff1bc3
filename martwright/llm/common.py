"""Helpers shared by the operators: row keys, one-time evaluation, opening tables."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from martwright.session import cut_lineage

__all__ = ["cut_lineage", "document_keys", "let", "open_table", "row_keys", "ship", "shuffle_width"]


def open_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table with the schema that its files carry."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(*columns: Column) -> list[Column]:
    """A 128-bit content key as two longs that are never null.

    Rows equal in all columns share the key, so repeated rows get the same answer.
    """
    return [
        F.xxhash64(F.lit(11), *columns).alias("k1"),
        F.xxhash64(F.lit(29), *columns).alias("k2"),
    ]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` loops over it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def document_keys(id_column: Column, text: Column, id_type: DataType) -> list[Column]:
    """Two longs, never null, that name a document: a digest of id and text, and the id.

    Rows equal in both share them. An id that is no integer is digested.
    """
    number = id_column.cast("long") if isinstance(id_type, IntegralType) else F.xxhash64(id_column)
    return [
        F.xxhash64(F.lit(11), id_column, text).alias("k1"),
        F.coalesce(number, F.lit(0)).cast("long").alias("k2"),
    ]


def ship(module: str) -> None:
    """Send the module's functions whole to the executors, which may not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
