"""Data tests: a test returns the offending rows, none means passed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.functions.values import ERROR, FAILED, PASSED, moment

RESULT = "name string, problem_rows bigint, status string, message string"


def not_empty(df: DataFrame) -> DataFrame:
    """One row when the table has no rows."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).filter("row_count = 0")


def not_stale(df: DataFrame, column: str, as_of: datetime, hours: int = 24) -> DataFrame:
    """One row when the newest value is older than ``hours``; an empty table passes."""
    oldest = moment(df, column, as_of - timedelta(hours=hours))
    return df.agg(F.max(column).alias("newest")).filter(F.col("newest") < oldest)


def null_rows(df: DataFrame, key: str, shown: list[str]) -> DataFrame:
    """Rows without a key."""
    return df.filter(F.col(key).isNull()).select(*shown)


def out_of_range(
    df: DataFrame, column: str, low: float, high: float, shown: list[str]
) -> DataFrame:
    """Rows outside ``[low, high]``; NULL is not out of range."""
    return df.filter((F.col(column) < low) | (F.col(column) > high)).select(*shown)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


@dataclass(frozen=True)
class RowTest:
    """A declared test whose problem count is an aggregate over the table."""

    name: str
    problems: Callable[[DataFrame], Column]


def expect_rows(name: str, floor: int = 1) -> RowTest:
    return RowTest(name, lambda df: F.when(F.count(F.lit(1)) < floor, 1).otherwise(0))


def expect_fresh(name: str, column: str, as_of: datetime, hours: int = 24) -> RowTest:
    since = as_of - timedelta(hours=hours)
    return RowTest(
        name, lambda df: F.when(F.max(column) < moment(df, column, since), 1).otherwise(0)
    )


def expect_key(name: str, key: str) -> RowTest:
    return RowTest(name, lambda df: F.count_if(F.col(key).isNull()))


def expect_range(name: str, column: str, low: float, high: float) -> RowTest:
    return RowTest(name, lambda df: F.count_if((F.col(column) < low) | (F.col(column) > high)))


def row_test_counts(df: DataFrame, tests: list[RowTest]) -> DataFrame:
    """All declared tests of one table in one scan: (name, problem_rows)."""
    measured = df.agg(*[t.problems(df).cast("bigint").alias(f"t{i}") for i, t in enumerate(tests)])
    rows = F.array(
        *[
            F.struct(F.lit(t.name).alias("name"), F.col(f"t{i}").alias("problem_rows"))
            for i, t in enumerate(tests)
        ]
    )
    return measured.select(F.inline(rows))


def violation_count(name: str, violations: DataFrame) -> DataFrame:
    """Problem count of a test given as its offending rows; the rows are never collected."""
    return violations.agg(F.count(F.lit(1)).alias("problem_rows")).select(
        F.lit(name).alias("name"), "problem_rows"
    )


def data_test_suite(
    spark: SparkSession,
    declared: list[tuple[DataFrame, list[RowTest]]] = (),
    custom: dict[str, str | Callable[[], DataFrame]] | None = None,
) -> DataFrame:
    """One row per test: name, problem rows, status, message.

    ``custom`` tests are SQL texts or functions that return the offending rows. They run one by
    one: a test that cannot be analysed or fails while running gets status ``error`` and
    the others are reported.
    """
    counted = [row_test_counts(df, tests) for df, tests in declared]
    parts = [run_each(spark, custom)] if custom or not counted else []
    if counted:
        results = reduce(DataFrame.unionByName, counted)
        verdict = F.when(F.col("problem_rows") > 0, FAILED).otherwise(PASSED)
        parts.append(
            results.select(
                "name",
                "problem_rows",
                verdict.alias("status"),
                F.when(verdict == FAILED, F.format_string("%d problem row(s)", "problem_rows"))
                .otherwise("")
                .alias("message"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def run_each(spark: SparkSession, custom: dict[str, str | Callable[[], DataFrame]]) -> DataFrame:
    """Run custom tests one by one, so that one failing at run time leaves the others alone.

    Only a count per test reaches the driver.
    """
    rows = []
    for name, test in sorted((custom or {}).items()):
        try:
            violations = spark.sql(test) if isinstance(test, str) else test()
            problems = violations.count()
            status = FAILED if problems else PASSED
            rows.append((name, problems, status, f"{problems} problem row(s)" if problems else ""))
        except PySparkException as error:
            rows.append((name, None, ERROR, error.getCondition() or type(error).__name__))
    return spark.createDataFrame(rows, RESULT)


def suite_totals(results: DataFrame) -> DataFrame:
    """Number of tests, passed and failing; an errored test is failing."""
    failing = F.col("status").isin(FAILED, ERROR)
    return results.agg(
        F.count(F.lit(1)).alias("tests"),
        F.count_if(F.col("status") == PASSED).alias("passed"),
        F.count_if(failing).alias("failing"),
    ).withColumn("exit_code", F.when(F.col("failing") > 0, 1).otherwise(0))


def failing_names(results: DataFrame) -> DataFrame:
    """Banner row: names of the failing tests, in order. One short name per test."""
    failing = results.filter(F.col("status").isin(FAILED, ERROR))
    return failing.agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("failing"))
