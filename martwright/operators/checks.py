"""Trust checks.

Every rule of every contract over one table is compiled into a single aggregate: one
scan, no shuffle but the merge of one row per task. Period rules compare the last
complete period before ``as_of`` with the one before it, as conditional sums of the
same aggregate. Only duplicate rates group the table by their column.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.functions.ordered import with_previous
from martwright.functions.periods import as_day, period_span
from martwright.functions.values import (
    ERROR,
    FAILED,
    PASSED,
    WARNING,
    change_percent,
    instant,
    percent,
    ratio,
    total,
    within,
)
from martwright.operators.rules import DEFAULT_TRUST, Rule, rules_of


# -- verdicts ------------------------------------------------------------------


def below(actual: Column, limit: float) -> Column:
    """``must be less than``: a limit of zero is met by exactly zero."""
    limit = F.lit(float(limit))
    return (actual < limit) | ((limit == 0) & (actual == 0))


def at_most(actual: Column, limit: float) -> Column:
    """``must not change more than``."""
    return actual <= F.lit(float(limit))


def verdict(met: Column) -> Column:
    """Status of a period; one without a baseline passes."""
    return F.when(~met, FAILED).otherwise(PASSED)


# -- aggregates ----------------------------------------------------------------


def hours_since(column: Column, as_of: datetime) -> Column:
    """Age in hours of a time aggregate."""
    micros = F.timestamp_diff("MICROSECOND", column.cast("timestamp_ntz"), instant(as_of))
    return micros / F.lit(3600000000.0)


def drop_percent(current: Column, previous: Column) -> Column:
    """How far the rows fell, on the 0-100 scale; growth is negative."""
    return percent(previous - current, previous)


class TableScan:
    """Collects the aggregates that the rules of one table need."""

    def __init__(self, df: DataFrame, time_column: str, as_of: datetime):
        self.df, self.time_column, self.as_of = df, time_column, as_of
        self.measures: dict[str, Column] = {}
        self.checks: list[Column] = []

    def measure(self, name: str, aggregate: Column) -> Column:
        self.measures.setdefault(name, aggregate.alias(name))
        return F.col(name)

    def span(self, grain: str, steps: int) -> Column:
        return within(self.df, self.time_column, *period_span(self.as_of, grain, steps))

    def rows(self, grain: str | None = None, steps: int = 0) -> Column:
        if grain is None:
            return self.measure("rows", F.count(F.lit(1)))
        return self.measure(f"rows_{grain}{steps}", F.count_if(self.span(grain, steps)))

    def total(self, rule: Rule, grain: str | None = None, steps: int = 0) -> Column:
        span = None if grain is None else self.span(grain, steps)
        return self.measure(
            f"sum_{rule.column_name}_{rule.digits}_{grain}{steps}",
            total(self.df, rule.column_name, span, rule.digits),
        )

    def present(self, column: str, grain: str, steps: int) -> Column:
        held = self.span(grain, steps) & F.col(column).isNotNull()
        return self.measure(f"n_{column}_{grain}{steps}", F.count_if(held))

    def add(self, rule: Rule) -> None:
        actual, met, missing = self._evaluate(rule)
        calm = None if rule.warn is None else actual <= F.lit(rule.warn)
        self.checks.append(finding(rule, actual, met, calm, missing))

    def _evaluate(self, rule: Rule) -> tuple[Column, Column, str]:
        kind, column, grain = rule.rule_type, rule.column_name, rule.period
        if kind == "freshness":
            newest = self.measure(f"max_{column}", F.max(column))
            age = hours_since(newest, self.as_of)
            return age, below(age, rule.max), ERROR
        if kind == "null_rate":
            nulls = self.measure(f"nulls_{column}", F.count_if(F.col(column).isNull()))
            rate = percent(nulls, self.rows())
            return rate, below(rate, rule.max), PASSED
        if kind == "range":
            value = self.total(rule)
            return value, value.between(rule.min, rule.max), ERROR
        if kind == "row_count":
            rows = self.rows().cast("double")
            return rows, rows > F.lit(rule.min), ERROR
        if kind == "volume":
            drop = drop_percent(self.rows(grain, -1), self.rows(grain, -2))
            return drop, at_most(drop, rule.max), PASSED
        if kind == "change":
            moved = F.abs(
                change_percent(self.total(rule, grain, -1), self.total(rule, grain, -2))
            )
            return moved, at_most(moved, rule.max), PASSED
        if kind == "distribution_shift":
            means = [
                ratio(self.total(rule, grain, s), self.present(column, grain, s))
                for s in (-1, -2)
            ]
            moved = F.abs(change_percent(*means))
            return moved, at_most(moved, rule.max), PASSED
        if kind == "trailing_average":
            moved = self._against_trailing(rule, int(rule.period.split()[0]))
            return moved, at_most(moved, rule.max), PASSED
        raise ValueError(f"rule {kind} is not a table aggregate")

    def _against_trailing(self, rule: Rule, days: int) -> Column:
        """Yesterday's value against the mean of the ``days`` days before it."""
        end = as_day(self.as_of) - timedelta(days=1)
        span = within(self.df, self.time_column, end - timedelta(days=days), end)
        held = F.col(self.time_column).cast("date")
        trail = self.measure(
            f"trail{days}_{rule.column_name}_{rule.digits}",
            total(self.df, rule.column_name, span, rule.digits),
        )
        # At most ``days`` distinct dates, so the set stays small in every task.
        seen = self.measure(f"trail{days}_days", F.size(F.collect_set(F.when(span, held))))
        return F.abs(change_percent(self.total(rule, "day", -1), ratio(trail, seen)))

    def results(self) -> DataFrame:
        return results(
            self.df.agg(*self.measures.values()).select(F.inline(F.array(*self.checks)))
        )


# -- result rows ---------------------------------------------------------------

# Names of the checks and units of their values, as result rows show them.
_LABELS = {
    "freshness": "Freshness",
    "null_rate": "Null rate on {column}",
    "volume": "Row count drop {period} over {period}",
    "range": "Value range",
    "change": "Value change {period} over {period}",
    "duplicate_rate": "Duplicate rate on {column}",
    "schema_drift": "Schema drift",
    "distribution_shift": "Mean of {column} {period} over {period}",
    "row_count": "Row count",
    "trailing_average": "Value against {period} average",
}


def label_of(rule: Rule) -> str:
    return _LABELS[rule.rule_type].format(column=rule.column_name, period=rule.period)


_UNITS = {"freshness": "h", "range": "", "row_count": "", "schema_drift": ""}


def limit_of(rule: Rule) -> str:
    """The threshold as a message shows it (fixed wording)."""
    unit = _UNITS.get(rule.rule_type, "%")
    if rule.rule_type == "schema_drift":
        return "no change"
    if rule.rule_type == "range":
        return f"{rule.min:.1f} to {rule.max:.1f}"
    if rule.rule_type == "row_count":
        return f"> {rule.min:.1f}"
    sign = "<" if rule.rule_type in ("freshness", "null_rate") else "<="
    return f"{sign} {rule.max:.1f}{unit}"


def finding(
    rule: Rule,
    actual: Column,
    met: Column,
    calm: Column | None = None,
    missing: str = PASSED,
) -> Column:
    """What a rule measured, as a struct; ``results`` turns it into a result row."""
    limit = rule.min if rule.rule_type == "row_count" else rule.max
    return F.struct(
        F.lit(rule.metric).alias("metric"),
        F.lit(rule.rule_type).alias("rule_type"),
        _literal(rule.column_name, "string").alias("column_name"),
        actual.cast("double").alias("actual_value"),
        _literal(limit, "double").alias("threshold"),
        met.alias("met"),
        (F.lit(True) if calm is None else calm).alias("calm"),
        F.lit(missing).alias("missing"),
        F.lit(label_of(rule)).alias("label"),
        F.lit(_UNITS.get(rule.rule_type, "%")).alias("unit"),
        F.lit(limit_of(rule)).alias("limit"),
    )


def _literal(value: str | float | None, kind: str) -> Column:
    return F.lit(None).cast(kind) if value is None else F.lit(value)



def results(findings: DataFrame) -> DataFrame:
    """The common output of every check."""
    status = (
        F.when(F.isnan("actual_value"), ERROR)
        .when(F.col("met").isNull(), F.col("missing"))
        .when(~F.col("met"), FAILED)
        .when(~F.col("calm"), WARNING)
        .otherwise(PASSED)
    )
    shown = F.when(
        F.col("actual_value").isNotNull(),
        F.concat(F.format_string("%.1f", "actual_value"), F.col("unit")),
    )
    return findings.withColumn("status", status).select(
        "metric",
        "rule_type",
        "column_name",
        "status",
        "actual_value",
        "threshold",
        F.format_string(
            "%s: %s (threshold: %s) — %s",
            "label",
            F.coalesce(shown, F.lit("nothing to compare")),
            "limit",
            F.upper("status"),
        ).alias("message"),
    )


def duplicate_result(df: DataFrame, rule: Rule) -> DataFrame:
    """Duplicate rate of one column: equal values are counted before the totals."""
    rate = duplicate_rates(df, rule.column_name)
    actual = F.col("duplicate_pct")
    found = rate.select(finding(rule, actual, at_most(actual, rule.max)).alias("r"))
    return results(found.select("r.*"))


def duplicate_rates(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a key, distinct keys and 100 * (rows - distinct) / rows."""
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    per_key = df.filter(filled).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_count"),
    ).withColumn(
        "duplicate_pct",
        percent(F.col("row_count") - F.col("distinct_count"), F.col("row_count")),
    )


def evaluate(
    contracts: list[dict],
    tables: dict[str, DataFrame],
    as_of: datetime,
    schema_history: DataFrame | None = None,
    defaults: Sequence[dict] = DEFAULT_TRUST,
) -> DataFrame:
    """Result rows of all contracts. Tables are scanned once, whatever the number of rules.

    A contract without rules gets the ``defaults``.

    A rule over another table than that of its contract uses the contract's time column.
    """
    scans: dict[tuple[str, str], TableScan] = {}
    apart: list[DataFrame] = []
    for contract in contracts:
        stamp = contract.get("time_column", "updated_at")
        for rule in rules_of(contract, defaults):
            df = tables[rule.table_name]
            if rule.rule_type == "duplicate_rate":
                apart.append(duplicate_result(df, rule))
            elif rule.rule_type == "schema_drift":
                apart.append(_drift_result(df, rule, schema_history))
            else:
                scan = scans.setdefault((rule.table_name, stamp), TableScan(df, stamp, as_of))
                scan.add(rule)
    return reduce(DataFrame.unionByName, [s.results() for s in scans.values()] + apart)


# -- schema drift --------------------------------------------------------------


def schema_snapshot(df: DataFrame, metric: str, run: int) -> DataFrame:
    """Columns and types of a table as rows; reads metadata only."""
    rows = [(metric, run, f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(
        rows, "metric string, run bigint, column_name string, column_type string"
    )


def fingerprint(history: DataFrame) -> DataFrame:
    """Hash of the set of columns and types per run; a table's columns are few."""
    entry = F.concat_ws(":", "column_name", "column_type")
    return history.groupBy("metric", "run").agg(
        F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(entry))), 256).alias("fingerprint")
    )


def schema_drift(history: DataFrame) -> DataFrame:
    """Columns added, removed or retyped against the previous run of the metric.

    ``history`` holds (metric, run, column_name, column_type) with a growing run number. A
    metric's first run has no baseline and reports nothing.
    """
    runs = history.select("metric", "run").distinct()
    chunk = F.floor(F.col("run") / 1024)
    steps = with_previous(runs, ["metric"], "run", F.col("run"), chunk, "previous_run").filter(
        F.col("previous_run").isNotNull()
    )
    before = (
        history.withColumnRenamed("run", "previous_run")
        .join(steps, ["metric", "previous_run"])
        .select("metric", "run", "column_name", F.col("column_type").alias("old_type"))
    )
    after = history.join(steps.select("metric", "run"), ["metric", "run"], "left_semi")
    after = after.withColumnRenamed("column_type", "new_type")
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return (
        before.join(after, ["metric", "run", "column_name"], "full_outer")
        .withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .select("metric", "run", "column_name", "change", "old_type", "new_type")
    )


def _drift_result(df: DataFrame, rule: Rule, history: DataFrame | None) -> DataFrame:
    """Drift of the table's schema against its last stored snapshot."""
    spark = df.sparkSession
    if history is None:
        changes = spark.createDataFrame([], "run bigint")
    else:
        past = history.filter(F.col("metric") == rule.metric)
        newest = past.groupBy("metric").agg(F.max("run").alias("run"))
        last = past.join(newest, ["metric", "run"], "left_semi").withColumn("run", F.lit(0))
        now = schema_snapshot(df, rule.metric, 1)
        changes = schema_drift(last.unionByName(now))
    counted = changes.agg(F.count(F.lit(1)).cast("double").alias("n"))
    found = counted.select(finding(rule, F.col("n"), F.col("n") == 0).alias("r"))
    return results(found.select("r.*"))


# -- checks over a series of periods -------------------------------------------


def per_period(
    df: DataFrame,
    time_column: str,
    grain: str,
    value: str,
    keys: list[str] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Rows, value and mean per calendar period (and key): the input of the series checks."""
    keys = keys or []
    bucket = F.trunc(F.col(time_column).cast("date"), grain) if grain != "day" else F.col(
        time_column
    ).cast("date")
    summed = total(df, value, digits=digits)
    return df.groupBy(*keys, bucket.alias("period")).agg(
        F.count(F.lit(1)).alias("row_count"),
        summed.alias("value"),
        ratio(summed, F.count(value)).alias("mean"),
    )


def _series(keys: list[str] | None):
    """Order of the few period rows of a key."""
    return Window.partitionBy(*(keys or [])).orderBy("period")


def volume_series(series: DataFrame, max_drop: float, keys: list[str] | None = None) -> DataFrame:
    """Fall of the row count against the previous period."""
    previous = F.lag("row_count").over(_series(keys))
    drop = drop_percent(F.col("row_count"), F.col("previous"))
    return (
        series.withColumn("previous", previous)
        .withColumn("drop_pct", drop)
        .select(
            *(keys or []), "period", "row_count", "previous", "drop_pct",
            verdict(at_most(F.col("drop_pct"), max_drop)).alias("status"),
        )
    )


def volume_median_series(
    series: DataFrame, floor_pct: float = 80.0, periods: int = 7, keys: list[str] | None = None
) -> DataFrame:
    """Row count above a share of the median of the previous periods."""
    before = _series(keys).rowsBetween(-periods, -1)
    median = F.percentile("row_count", F.lit(0.5)).over(before)
    floor = F.col("median") * F.lit(floor_pct / 100.0)
    return (
        series.withColumn("median", median)
        .select(
            *(keys or []), "period", "row_count", "median",
            verdict(F.col("row_count") >= floor).alias("status"),
        )
    )


def change_series(
    series: DataFrame, max_change: float, column: str = "value", keys: list[str] | None = None
) -> DataFrame:
    """Move of a value (or mean) against the previous period, in both directions."""
    previous = F.lag(column).over(_series(keys))
    moved = F.abs(change_percent(F.col(column), F.col("previous")))
    return (
        series.withColumn("previous", previous)
        .withColumn("change_pct", moved)
        .select(
            *(keys or []), "period", column, "previous", "change_pct",
            verdict(at_most(F.col("change_pct"), max_change)).alias("status"),
        )
    )


def trailing_average_series(
    series: DataFrame, max_change: float, periods: int = 30, keys: list[str] | None = None
) -> DataFrame:
    """Value against the mean of up to ``periods`` periods before it."""
    before = _series(keys).rowsBetween(-periods, -1)
    exact = F.col("value").cast("decimal(28,4)")
    mean = ratio(F.sum(exact).over(before), F.count(exact).over(before))
    moved = F.abs(change_percent(F.col("value"), F.col("trailing_avg")))
    return (
        series.withColumn("trailing_avg", mean)
        .withColumn("change_pct", moved)
        .select(
            *(keys or []), "period", "value", "trailing_avg", "change_pct",
            verdict(at_most(F.col("change_pct"), max_change)).alias("status"),
        )
    )
