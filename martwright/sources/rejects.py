"""Loads that go on over damaged lines: fitting rows go to the table, the others to a quarantine.

The files are parsed once. A line that does not fit the declared columns (a value of another type, too
few or too many fields) keeps its whole text; the parsed rows are written once, in one folder of
fitting and one of damaged lines, and table and quarantine are made from these. Lines that hold
nothing at all are no rows, as in every CSV scan. Both parts add up to the lines of the files.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martwright.session import scratch_dir
from martwright.sources.files import declared_schema, scan_csv, stamp_loaded
from martwright.sources.load import LoadResult, load

# Suffix of the quarantine of a table, and its column that names the load.
REJECTS, LOAD = "__rejects", "_load"


class TooManyRejects(ValueError):
    """More lines were damaged than the rule allows; the table was left as it was."""


@dataclass(frozen=True)
class SplitResult:
    loaded: LoadResult
    rows: int
    rejected: int


def scan_with_rejects(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    glob: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """The declared columns, ``_line`` (the text of a damaged line, else NULL), ``_reason`` and ``_file``."""
    damaged = spark.conf.get("spark.sql.columnNameOfCorruptRecord")
    wide = T.StructType([*schema.fields, T.StructField(damaged, T.StringType())])
    rows = scan_csv(spark, path, wide, glob, multiline)
    return rows.select(
        *schema.names,
        F.col(damaged).alias("_line"),
        F.when(F.col(damaged).isNotNull(), _reason(schema, F.col(damaged))).alias("_reason"),
        F.col("_metadata.file_path").alias("_file"),
    )


def _reason(schema: T.StructType, line: Column) -> Column:
    """Every value that is not of its column's type, else that the number of fields is wrong."""
    texts = F.from_csv(line, ", ".join(f"`{c}` string" for c in schema.names), {"escape": '"'})
    wrong = [
        F.when(
            texts[f.name].isNotNull() & F.col(f"`{f.name}`").isNull(),
            F.concat(
                F.lit(f"{f.name}: '"), texts[f.name], F.lit(f"' is not {f.dataType.simpleString()}")
            ),
        )
        for f in schema.fields
    ]
    return F.coalesce(F.nullif(F.concat_ws("; ", *wrong), F.lit("")), F.lit("number of fields"))


def load_with_rejects(
    spark: SparkSession, spec: dict, root: str, as_of: datetime, max_rate: float = 0.01
) -> SplitResult:
    """Load the fitting lines of a spec with declared columns by its mode.

    The damaged lines go to ``<table>__rejects`` (line, reason, file, _loaded_at); a load that runs again
    with the same ``as_of`` replaces its own. If their share of all lines is above ``max_rate``, they are
    kept there too, the table is not touched and ``TooManyRejects`` is raised. No line at all is share 0.
    """
    source, target = spec["source"], spec["target"]
    if source["type"] != "csv":
        raise NotImplementedError(f"source type '{source['type']}' is not supported, only csv")
    schema = declared_schema(spec.get("columns"))
    if schema is None:
        raise ValueError("rejected lines need declared columns")
    parsed = scan_with_rejects(
        spark, source["path"], schema, source.get("glob"), bool(source.get("multiline", False))
    )
    staged = scratch_dir(spark, "split")
    fits = F.col("_line").isNull().alias("_fits")
    parsed.select("*", fits).write.partitionBy("_fits").parquet(staged)
    both = spark.read.schema(
        T.StructType([*parsed.schema.fields, T.StructField("_fits", T.BooleanType())])
    ).parquet(staged)

    counts = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_fits")).alias("bad")).first()
    path = f"{root}/{target['table']}"
    if counts["bad"]:
        kept = both.filter(~F.col("_fits")).select(
            F.col("_line").alias("line"), F.col("_reason").alias("reason"), F.col("_file").alias("file")
        )
        kept = stamp_loaded(kept, as_of).withColumn(LOAD, F.lit(f"at-{as_of:%Y%m%dT%H%M%S%f}"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            LOAD
        ).parquet(path + REJECTS)
    if counts["bad"] > max_rate * counts["n"]:
        raise TooManyRejects(
            f"{path}: {counts['bad']} of {counts['n']} lines rejected, more than {max_rate:.2%}"
        )
    key = target.get("primary_key")
    loaded = load(
        stamp_loaded(both.filter("_fits").select(*schema.names), as_of),
        path,
        target.get("mode", "append"),
        [key] if isinstance(key, str) else key,
        target.get("newest"),
        target.get("partition_by"),
        target.get("buckets"),
    )
    return SplitResult(loaded, counts["n"], counts["bad"])


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """The quarantine of the table at ``path``."""
    return spark.read.parquet(path + REJECTS).drop(LOAD)
