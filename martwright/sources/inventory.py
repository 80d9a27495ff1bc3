"""What is stored: row counts per table, health of ingest targets, row previews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.sources.files import target_table

_COUNTS = "table_name string, row_count bigint"


def counting_session(spark: SparkSession) -> SparkSession:
    """A session whose parquet scans answer a bare count from the footers of the files.

    Tables opened with it are counted as one number per file, without a row leaving the scan.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def table_counts(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """One row per table; a table that cannot be read has a NULL count.

    A bare count reads no columns; of tables opened with a ``counting_session`` it reads the footers alone.
    """
    parts = []
    for name, frame in sorted(tables.items()):
        if frame is None:
            parts.append(spark.createDataFrame([(name, None)], _COUNTS))
        else:
            parts.append(
                frame.agg(F.count(F.lit(1)).alias("row_count")).select(
                    F.lit(name).alias("table_name"), "row_count"
                )
            )
    return reduce(DataFrame.unionByName, parts)


def table_inventory(
    spark: SparkSession, tables: dict[str, DataFrame | None], entities: list[dict]
) -> DataFrame:
    """Row counts next to the entity and the whole description that cover each table."""
    described = spark.createDataFrame(
        [(e["table"], e["entity"], e.get("description")) for e in entities],
        "table_name string, entity string, description string",
    )
    counts = table_counts(spark, tables)
    return counts.join(described, "table_name", "left").select(
        "table_name",
        F.coalesce(F.col("row_count").cast("string"), F.lit("?")).alias("row_count"),
        F.coalesce("entity", F.lit("—")).alias("entity"),
        F.coalesce("description", F.lit("")).alias("description"),
    )


def ingest_health(
    spark: SparkSession, specs: dict[str, dict], tables: dict[str, DataFrame | None]
) -> DataFrame:
    """Per ingest spec: target table, its rows, and ``loaded`` or ``missing``."""
    targets = spark.createDataFrame(
        [(name, target_table(name, spec)) for name, spec in sorted(specs.items())],
        "ingest string, table_name string",
    )
    return targets.join(table_counts(spark, tables), "table_name", "left").select(
        "ingest",
        "table_name",
        "row_count",
        F.when(F.col("row_count").isNull(), "missing").otherwise("loaded").alias("state"),
    )


def preview(df: DataFrame, keys: list[str], rows: int = 100) -> DataFrame:
    """The first rows by key; the key makes the choice repeatable."""
    return df.orderBy(*keys).limit(rows)
