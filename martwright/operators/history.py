"""Run history: snapshots, append-only tables, latest state, streaks, revisions, catalog."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.functions.ordered import islands, with_previous
from martwright.functions.values import (
    ERROR,
    FAILED,
    PASSED,
    WARNING,
    dedup_key,
    instant,
    ratio,
    short_status,
    total,
)


def schema_fingerprint(df: DataFrame) -> str:
    """Text that the fingerprint hashes: sorted ``column:type`` entries."""
    return ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields))


def run_snapshot(
    df: DataFrame,
    metric: str,
    value_column: str,
    mean_columns: list[str],
    as_of: datetime,
    digits: int | None = None,
) -> DataFrame:
    """What a run stores about its table, in one pass."""
    means = []
    for c in mean_columns:
        mean = ratio(total(df, c, digits=digits), F.count(c))
        means.append(F.when(mean.isNotNull(), F.format_string("%.4f", mean)).alias(c))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        total(df, value_column, digits=digits).alias("value_sum"),
        F.to_json(F.struct(*means)).alias("column_means_json"),
    ).select(
        F.lit(metric).alias("metric_name"),
        instant(as_of).alias("started_at"),
        "row_count",
        "value_sum",
        F.sha2(F.lit(schema_fingerprint(df)), 256).alias("schema_fingerprint"),
        "column_means_json",
    )


def append_history(rows: DataFrame, path: str, time_column: str = "started_at") -> None:
    """Append to a history table partitioned by month of ``time_column``."""
    month = F.date_format(time_column, "yyyy-MM")
    rows.withColumn("month", month).write.mode("append").partitionBy("month").parquet(path)


def baseline(runs: DataFrame) -> DataFrame:
    """The columns a period comparison needs: metric_name, recorded_at, value_sum, row_count."""
    return runs.select(
        "metric_name", F.col("started_at").alias("recorded_at"), "value_sum", "row_count"
    )


def previous_period_run(runs: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Per metric the last run at least one period before ``as_of``."""
    before = runs.filter(F.col("started_at") <= instant(as_of - timedelta(days=days)))
    return latest_run(before)


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest run per metric."""
    rest = [c for c in runs.columns if c not in ("metric_name", "started_at")]
    chosen = F.max(F.struct("started_at", *rest)).alias("_run")
    return runs.groupBy("metric_name").agg(chosen).select("metric_name", "_run.*")


def latest_status(runs: DataFrame, as_of: datetime, stale_days: int = 7) -> DataFrame:
    """Latest run per metric with its display word and traffic light.

    Grey means no run within ``stale_days``.
    """
    status = F.col("status")
    light = (
        F.when(F.col("started_at") < instant(as_of - timedelta(days=stale_days)), "grey")
        .when(status.isin(FAILED, ERROR), "red")
        .when(status == WARNING, "yellow")
        .when(status == PASSED, "green")
        .otherwise("grey")
    )
    return latest_run(runs).select(
        "metric_name",
        "started_at",
        "status",
        short_status(status).alias("short_status"),
        light.alias("light"),
    )


def last_runs(runs: DataFrame, rows: int = 30, keys: tuple[str, ...] = ("metric_name",)) -> DataFrame:
    """The newest runs per key with their place, 1 is the oldest of them.

    The rank filter lets each map task keep only its own newest rows before the shuffle.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("started_at"))
    kept = runs.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= rows)
    ascending = Window.partitionBy(*keys).orderBy("started_at")
    return kept.drop("_rank").withColumn("position", F.row_number().over(ascending))


def run_status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("triggered_by", "status").agg(F.count(F.lit(1)).alias("runs"))


def status_streaks(results: DataFrame, least: int, chunk: Column | None = None) -> DataFrame:
    """Unbroken stretches of at least ``least`` runs of equal status.

    ``results`` holds (metric, rule, started_at, status). Runs of one rule are split
    by month unless another ``chunk`` is given.
    """
    chunk = F.trunc(F.col("started_at").cast("date"), "month") if chunk is None else chunk
    runs = results.select("metric", "rule", "started_at", "status")
    stretches = islands(runs, ["metric", "rule"], "started_at", "status", chunk)
    return stretches.filter(F.col("runs") >= least)


# An issue opens after this many failed runs in a row and closes after
# as many passed ones; its kind and the number of runs it shows.
STREAK_LENGTH = 3
ISSUE_KIND = "trust-regression"
SHOWN_RUNS = 5


def issue_title() -> Column:
    """Fixed wording: issues are found again by it."""
    return F.format_string("[trust] %s failed: %s", F.col("metric"), F.col("rule"))


def failing_streaks(results: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Failing streaks as issue rows; the key is equal for all streaks of one rule."""
    title = issue_title()
    failing = status_streaks(results, STREAK_LENGTH, chunk).filter(F.col("status") == FAILED)
    return failing.select(
        "metric",
        "rule",
        "streak_start",
        "streak_end",
        "runs",
        title.alias("title"),
        dedup_key(F.lit(ISSUE_KIND), title).alias("dedup_key"),
    )


def recovered_streaks(results: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Per metric and rule with a failing streak: the first passing streak after the last one."""
    streaks = status_streaks(results, STREAK_LENGTH, chunk)
    failing = (
        streaks.filter(F.col("status") == FAILED)
        .groupBy("metric", "rule")
        .agg(F.max("streak_end").alias("failed_until"))
    )
    return (
        streaks.filter(F.col("status") == PASSED)
        .join(failing, ["metric", "rule"])
        .filter(F.col("streak_start") > F.col("failed_until"))
        .groupBy("metric", "rule")
        .agg(
            F.min("failed_until").alias("failed_until"),
            F.min("streak_start").alias("recovered_from"),
        )
    )


def issue_drafts(results: DataFrame, chunk: Column | None = None) -> DataFrame:
    """One issue per rule with a failing streak, with its newest runs as text.

    ``results`` also holds ``message``. Only ``SHOWN_RUNS`` rows per rule are joined to text.
    """
    streaks = failing_streaks(results, chunk).groupBy("metric", "rule", "title", "dedup_key").agg(
        F.count(F.lit(1)).alias("streaks"), F.max("runs").alias("longest")
    )
    line = F.format_string(
        "- %s: %s (%s)",
        F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"),
        F.col("status"),
        F.coalesce("message", F.lit("")),
    )
    newest = last_runs(results, SHOWN_RUNS, ("metric", "rule"))
    history = newest.groupBy("metric", "rule").agg(
        F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("recent_history")
    )
    return streaks.join(history, ["metric", "rule"])


def kept_revisions(
    revisions: DataFrame, keys: list[str], order: str, text: str, chunk: Column | list[Column]
) -> DataFrame:
    """Revisions whose text differs from the one before; compared by hash, split by ``chunk``."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    seen = with_previous(revisions, keys, order, digest, chunk, "_before")
    return seen.filter(F.col("_before").isNull() | (F.col("_before") != digest)).drop("_before")


def latest_revisions(
    revisions: DataFrame,
    keys: list[str],
    order: str,
    text: str,
    chunk: Column | list[Column],
    rows: int = 30,
) -> DataFrame:
    """The newest kept revisions per key, place 1 is the newest."""
    kept = kept_revisions(revisions, keys, order, text, chunk)
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return kept.withColumn("position", F.row_number().over(newest)).filter(
        F.col("position") <= rows
    )


def table_freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Newest time per table; ``{table: (rows, time column)}``."""
    parts = [
        df.agg(F.max(column).cast("timestamp_ntz").alias("newest")).select(
            F.lit(name).alias("table_name"), "newest"
        )
        for name, (df, column) in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def freshness_header(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``data through``: the oldest of the newest times, empty tables left out."""
    newest = table_freshness(tables).filter(F.col("newest").isNotNull())
    oldest = F.min(F.struct("newest", "table_name"))
    return newest.agg(oldest.alias("o"), F.count(F.lit(1)).alias("tables")).select(
        F.col("o.newest").alias("data_through"),
        F.col("o.table_name").alias("oldest_table"),
        "tables",
    )


def catalog_search(
    catalog: DataFrame,
    text_columns: list[str],
    q: str | None = None,
    equals: dict[str, str] | None = None,
    order: str = "metric",
    after: object = None,
    page_size: int = 20,
) -> DataFrame:
    """One page of the entries that contain ``q`` in any case and match the given values.

    ``after`` is the last ``order`` value of the page before, so that a page far back costs
    no more than the first.
    """
    found = catalog
    if q:
        wanted = F.lit(q.lower())
        hits = [F.contains(F.lower(F.col(c)), wanted) for c in text_columns]
        found = found.filter(reduce(lambda a, b: a | b, hits))
    for column, value in (equals or {}).items():
        found = found.filter(F.col(column) == value)
    if after is not None:
        found = found.filter(F.col(order) > F.lit(after))
    return found.orderBy(order).limit(page_size)
