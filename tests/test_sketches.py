"""Stored sketches against exact distinct counts and ranks."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from martwright.operators import sketches

FIRST = date(2024, 1, 1)


def made(spark, users=20_000, days=12):
    """Every user on three days in a row, with values that grow."""
    return spark.range(users * 3).select(
        (F.col("id") % users).alias("user_id"),
        F.expr(f"TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(CAST((id % {users}) % {days - 2} + id DIV {users} AS INT))").alias("ts"),
        (F.col("id") % 9973).cast("double").alias("value"),
    )


def test_windows_are_within_the_stated_error(spark):
    events = made(spark).repartition(4).cache()
    days = sketches.by_day(events, "ts", "user_id", "value")
    assert days.count() == 12
    found = {r["window_end"]: r for r in sketches.trailing(days, 5, FIRST, FIRST + timedelta(days=11)).collect()}
    assert len(found) == 12
    day = F.col("ts").cast("date")
    for end, row in found.items():
        window = events.where(day.between(F.lit(end - timedelta(days=4)), F.lit(end)))
        exact, n, upto = window.agg(
            F.count_distinct("user_id"), F.count(F.lit(1)), F.count_if(F.col("value") <= row["quantile"])
        ).first()
        assert row["rows"] == n
        assert abs(row["distinct_keys"] - exact) <= 0.05 * exact
        assert abs(upto / n - 0.5) <= 0.03
    whole = sketches.over(days, FIRST, FIRST + timedelta(days=30)).first()
    assert whole["days"] == 12 and abs(whole["distinct_keys"] - 20_000) <= 1_000


def test_a_day_that_comes_again_replaces_its_row_only(spark):
    events = made(spark, 2000)
    days = sketches.by_day(events, "ts", "user_id", "value")
    late = events.where(F.col("ts") < F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'")).limit(0)
    day_two = F.col("day") == F.lit(date(2024, 1, 2))
    again = days.where(~day_two).unionByName(
        sketches.by_day(events.unionByName(late), "ts", "user_id", "value").where(day_two)
    )
    one, two = (sketches.over(d, FIRST, date(2024, 1, 12)).first() for d in (days, again))
    assert (one["rows"], one["distinct_keys"]) == (two["rows"], two["distinct_keys"])


def test_odd_rows(spark):
    rows = [(None, datetime(2024, 1, 1), 1.0), (1, datetime(2024, 1, 1), None), (1, datetime(2024, 1, 1), 3.0)]
    schema = "user_id long, ts timestamp_ntz, value double"
    days = sketches.by_day(spark.createDataFrame(rows, schema), "ts", "user_id", "value")
    row = sketches.over(days, FIRST, FIRST).first()
    assert (row["rows"], row["distinct_keys"]) == (3, 1) and row["quantile"] in (1.0, 3.0)
    none = sketches.by_day(spark.createDataFrame([], schema), "ts", "user_id", "value")
    assert sketches.over(none, FIRST, FIRST).collect() == []
    assert sketches.trailing(none, 7, FIRST, FIRST).collect() == []
