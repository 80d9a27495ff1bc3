"""Periods, status words, ordered helpers and the exact percentile."""

import random
from datetime import date, datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from martwright.functions import periods, values
from martwright.functions.ordered import islands, with_previous, with_running_sum
from martwright.functions.percentiles import exact_percentile
from martwright.functions.skew import salted_join

AS_OF = date(2024, 5, 16)


@pytest.mark.parametrize(
    "name, span",
    [
        ("current_day", (date(2024, 5, 16), date(2024, 5, 17))),
        ("yesterday", (date(2024, 5, 15), date(2024, 5, 16))),
        ("last_7_days", (date(2024, 5, 9), date(2024, 5, 16))),
        ("last_30_days", (date(2024, 4, 16), date(2024, 5, 16))),
        ("current_week", (date(2024, 5, 13), date(2024, 5, 20))),
        ("last_week", (date(2024, 5, 6), date(2024, 5, 13))),
        ("current_month", (date(2024, 5, 1), date(2024, 6, 1))),
        ("current_period", (date(2024, 5, 1), date(2024, 6, 1))),
        ("last_period", (date(2024, 4, 1), date(2024, 5, 1))),
        ("mtd", (date(2024, 5, 1), date(2024, 5, 17))),
        ("current_quarter", (date(2024, 4, 1), date(2024, 7, 1))),
        ("last_quarter", (date(2024, 1, 1), date(2024, 4, 1))),
        ("qtd", (date(2024, 4, 1), date(2024, 5, 17))),
        ("last_year", (date(2023, 1, 1), date(2024, 1, 1))),
        ("ytd", (date(2024, 1, 1), date(2024, 5, 17))),
        ("all_time", (None, None)),
    ],
)
def test_window_span(name, span):
    assert periods.window_span(name, AS_OF) == span


def test_every_window_name_has_a_span():
    assert len(periods.WINDOW_NAMES) == 18
    for name in periods.WINDOW_NAMES:
        periods.window_span(name, AS_OF)
    with pytest.raises(ValueError):
        periods.window_span("next_week", AS_OF)


def test_thresholds_are_read():
    assert periods.hours_of("6 hours") == 6
    assert periods.hours_of("30 minutes") == 0.5
    assert periods.hours_of("1 day") == 24
    assert periods.number_of("0.5%") == 0.5
    assert periods.number_of("10,000,000") == 10_000_000
    assert periods.grain_of("week over week") == "week"
    with pytest.raises(ValueError):
        periods.grain_of("year over year")


def test_status_words(spark):
    rows = spark.createDataFrame(
        [("passed",), ("warning",), ("failed",), ("error",), ("odd",), (None,)], "s string"
    )
    short = [r[0] for r in rows.select(values.short_status(F.col("s"))).collect()]
    assert short == ["pass", "warn", "fail", "fail", "warn", "warn"]


def test_worst_status(spark):
    rows = spark.createDataFrame([("a", "passed"), ("a", "warning"), ("b", "error")], "k string, s string")
    worst = rows.groupBy("k").agg(values.worst_status(F.col("s")).alias("w")).collect()
    assert dict(worst) == {"a": "warning", "b": "error"}


def test_division_by_zero_is_null(spark):
    row = spark.range(1).select(
        values.ratio(F.lit(1), F.lit(0)).alias("r"), values.percent(F.lit(1), F.lit(0)).alias("p")
    ).first()
    assert row["r"] is None and row["p"] is None


def test_total_is_exact_for_any_row_order(spark):
    amounts = [0.1, 0.2, 0.3, 1e9, 0.07] * 1000
    random.Random(1).shuffle(amounts)
    rows = spark.createDataFrame([(a,) for a in amounts], "amount double").repartition(7)
    rows = values.scaled(rows, "amount", 2)
    assert rows.agg(values.total(rows, "amount")).first()[0] == 1000000000670.0
    decimals = spark.sql("SELECT CAST(1.25 AS DECIMAL(12,2)) AS amount")
    assert decimals.agg(values.total(decimals, "amount")).first()[0] == 1.25


def test_dedup_key(spark):
    import hashlib

    row = spark.range(1).select(values.dedup_key(F.lit("bug"), F.lit("title")).alias("k")).first()
    assert row["k"] == hashlib.sha1(b"bug::title").hexdigest()[:12]


# -- ordered helpers against a plain loop --------------------------------------


def series(seed):
    rng = random.Random(seed)
    rows = []
    for key in "abc":
        at = 0
        for _ in range(rng.randint(1, 60)):
            at += rng.randint(1, 9)
            rows.append((key, at, rng.choice(["passed", "failed", None])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("width", [1, 10, 1000])
def test_previous_running_sum_and_islands(spark, seed, width):
    rows = series(seed)
    frame = spark.createDataFrame(rows, "k string, at int, s string")
    chunk = F.floor(F.col("at") / width)

    before = with_previous(frame, ["k"], "at", F.col("s"), chunk, "prev")
    summed = with_running_sum(before, ["k"], "at", F.col("at"), chunk, "running")
    got = {(r["k"], r["at"]): (r["prev"], r["running"]) for r in summed.collect()}
    stretches = islands(frame, ["k"], "at", "s", chunk).collect()
    found = {(r["k"], r["s"], r["streak_start"], r["streak_end"], r["runs"]) for r in stretches}

    want, expected = {}, set()
    for key in "abc":
        mine = sorted((at, s) for k, at, s in rows if k == key)
        running = 0
        for i, (at, s) in enumerate(mine):
            running += at
            want[(key, at)] = (mine[i - 1][1] if i else None, running)
        start = 0
        for i in range(1, len(mine) + 1):
            if i == len(mine) or mine[i][1] != mine[start][1]:
                expected.add((key, mine[start][1], mine[start][0], mine[i - 1][0], i - start))
                start = i
    assert got == want
    # A leading stretch of NULL status starts no island of its own name; compare the named ones.
    assert {f for f in found if f[1] is not None} == {e for e in expected if e[1] is not None}


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(st.integers(-(10**13), 10**13), min_size=1, max_size=40),
    st.sampled_from([0.0, 0.25, 0.5, 0.9, 1.0]),
)
def test_exact_percentile_matches_interpolation(spark, numbers, fraction):
    frame = spark.createDataFrame([(n,) for n in numbers] + [(None,)], "v bigint")
    got = exact_percentile(frame, F.col("v"), fraction, "p").first()["p"]
    assert got == pytest.approx(float(np.quantile(numbers, fraction)), rel=1e-9, abs=1e-6)


def test_exact_percentile_of_nothing_and_of_one_hot_value(spark):
    empty = spark.createDataFrame([], "v bigint")
    assert exact_percentile(empty, F.col("v"), 0.5, "p").first()["p"] is None
    hot = spark.range(10000).select(F.when(F.col("id") < 9000, 7).otherwise(F.col("id")).alias("v"))
    assert exact_percentile(hot, F.col("v"), 0.5, "p").first()["p"] == 7


def test_salted_join_is_a_plain_join(spark):
    large = spark.range(1000).select(
        F.when(F.col("id") < 400, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    small = spark.createDataFrame([(1, "a"), (1, "b"), (500, "c"), (5000, "d")], "k bigint, w string")
    salted = salted_join(large, small, ["k"], F.col("v"), 7)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, large.join(small, "k").collect()))
    assert salted.count() == 801


def test_moment_takes_the_type_of_the_column(spark):
    rows = spark.sql("SELECT DATE'2024-01-01' AS d, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS t")
    for column in ("d", "t"):
        kept = rows.filter(values.within(rows, column, datetime(2024, 1, 1), date(2024, 1, 2)))
        assert kept.count() == 1
