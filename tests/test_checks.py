"""Data tests, trust rules, contracts, scores and schema drift."""

from datetime import date, datetime, timedelta

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from martwright.operators import checks, data_tests, rules, suite


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(fx.ORDERS, fx.ORDERS_SCHEMA)


def contract(*trust, **extra):
    return {"metric": "m", "table": "orders", "trust": list(trust), **extra}


def only(contract_, tables, as_of=fx.NOW):
    (row,) = checks.evaluate([contract_], tables, as_of).collect()
    return row


# -- data tests ----------------------------------------------------------------


def test_violations(orders):
    assert data_tests.not_empty(orders).count() == 0
    assert data_tests.not_empty(orders.limit(0)).first()["row_count"] == 0
    assert data_tests.null_rows(orders, "amount", ["order_id"]).first()["order_id"] == 3
    out = data_tests.out_of_range(orders, "amount", 100, 400, ["order_id"])
    assert sorted(r[0] for r in out.collect()) == [4, 5]
    twice = data_tests.duplicate_keys(orders.union(orders.limit(1)), ["order_id"])
    assert [tuple(r) for r in twice.collect()] == [(1, 2)]


def test_freshness_boundaries(orders):
    newest = datetime(2026, 4, 5, 12)
    fresh = lambda now: data_tests.not_stale(orders, "updated_at", now).count() == 0
    assert fresh(newest + timedelta(hours=24))
    assert not fresh(newest + timedelta(hours=24, seconds=1))
    # An empty table has no newest time, and the comparison with NULL returns no row.
    assert data_tests.not_stale(orders.limit(0), "updated_at", fx.NOW).count() == 0


def test_suite_counts_errors_as_failing(spark, orders):
    orders.createOrReplaceTempView("suite_orders")
    results = data_tests.data_test_suite(
        spark,
        [(orders, [data_tests.expect_rows("rows"), data_tests.expect_key("amount", "amount")])],
        {
            "good": "SELECT 1 FROM suite_orders WHERE order_id < 0",
            "bad": "SELECT 1 FROM suite_orders",
            "broken": "SELECT nothing FROM suite_orders",
        },
    )
    status = {r["name"]: (r["problem_rows"], r["status"]) for r in results.collect()}
    assert status == {
        "rows": (0, "passed"),
        "amount": (1, "failed"),
        "good": (0, "passed"),
        "bad": (5, "failed"),
        "broken": (None, "error"),
    }
    totals = data_tests.suite_totals(results).first()
    assert (totals["tests"], totals["passed"], totals["failing"], totals["exit_code"]) == (5, 2, 3, 1)
    assert data_tests.failing_names(results).first()["failing"] == "amount, bad, broken"


def test_a_test_that_breaks_while_running_leaves_the_others(spark, orders):
    orders.createOrReplaceTempView("run_orders")
    rows = data_tests.run_each(
        spark,
        {
            "divides": "SELECT 1 FROM run_orders WHERE 1 / (order_id - 1) > 0",
            "fine": "SELECT 1 FROM run_orders WHERE order_id = 9",
        },
    ).collect()
    assert {r["name"]: r["status"] for r in rows} == {"divides": "error", "fine": "passed"}


def test_no_tests_pass(spark):
    empty = data_tests.data_test_suite(spark)
    assert empty.count() == 0
    assert data_tests.suite_totals(empty).first()["exit_code"] == 0


# -- rules ---------------------------------------------------------------------


def test_contract_of_the_five_orders(orders):
    wanted = contract(
        {"freshness": {"max": "24 hours"}},
        {"null_rate": {"column": "amount", "max": "5%"}},
        {"volume": {"max_drop": "25%", "period": "day over day"}},
        {"range": {"min": "0", "max": "1,000,000"}},
        {"change": {"max": "50%", "period": "month over month"}},
        {"duplicate_rate": {"column": "order_id", "max": "0%"}},
        time_column="updated_at",
        digits=2,
    )
    rows = {r["rule_type"]: r for r in checks.evaluate([wanted], {"orders": orders}, fx.NOW).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        "freshness": "passed",
        "null_rate": "failed",
        "volume": "passed",
        "range": "passed",
        "change": "passed",
        "duplicate_rate": "passed",
    }
    assert rows["null_rate"]["actual_value"] == 20.0
    assert rows["null_rate"]["message"] == "Null rate on amount: 20.0% (threshold: < 5.0%) — FAILED"
    assert rows["range"]["actual_value"] == 925.75
    assert rows["freshness"]["actual_value"] == 12.0
    assert rows["duplicate_rate"]["actual_value"] == 0.0
    assert rows["change"]["actual_value"] is None


def test_alignment_contract_passes_six_of_seven(spark):
    table = spark.createDataFrame(fx.ALIGNMENT, fx.ALIGNMENT_SCHEMA)
    wanted = contract(
        {"freshness": {"max": "6 hours"}},
        {"null_rate": {"column": "amount", "max": "5%"}},
        {"null_rate": {"column": "order_id", "max": "0%"}},
        {"null_rate": {"column": "status", "max": "0%"}},
        {"volume": {"max_drop": "20%", "period": "day over day"}},
        {"range": {"min": 1000000, "max": 20000000}},
        {"change": {"max": "30%", "period": "month over month"}},
        time_column="updated_at",
    )
    results = checks.evaluate([wanted], {"orders": table}, datetime(2026, 4, 2))
    (score,) = suite.metric_scores(results).collect()
    assert (score["trust_score"], score["trust_total"], score["status"]) == (6.0, 7, "failed")
    assert score["scorecard"] == "FAIL"
    failed = results.filter("status = 'failed'").first()
    assert failed["message"] == "Null rate on amount: 12.5% (threshold: < 5.0%) — FAILED"
    value = results.filter("rule_type = 'range'").first()["actual_value"]
    assert value == 4_750_000.0


def test_zero_limit_is_met_by_zero_only(orders):
    rule = {"null_rate": {"column": "order_id", "max": "0%"}}
    assert only(contract(rule), {"orders": orders})["status"] == "passed"
    rule = {"null_rate": {"column": "amount", "max": "20%"}}
    assert only(contract(rule), {"orders": orders})["status"] == "failed"
    rule = {"null_rate": {"column": "amount", "max": "20.1%", "warn": "10%"}}
    assert only(contract(rule), {"orders": orders})["status"] == "warning"


def test_defaults_of_a_contract_without_rules(orders):
    rows = checks.evaluate([{"metric": "d", "table": "orders"}], {"orders": orders}, fx.NOW).collect()
    assert {(r["rule_type"], r["threshold"]) for r in rows} == {
        ("freshness", 24.0),
        ("null_rate", 5.0),
        ("volume", 25.0),
    }


def test_unknown_rule_raises():
    with pytest.raises(ValueError):
        rules.rules_of(contract({"colour": {"max": 1}}))


def test_empty_table_is_an_error_where_a_value_is_needed(orders):
    empty = orders.limit(0)
    fresh = only(contract({"freshness": {"max": "1 day"}}), {"orders": empty})
    assert fresh["status"] == "error"
    assert fresh["message"] == "Freshness: nothing to compare (threshold: < 24.0h) — ERROR"
    rate = only(contract({"null_rate": {"column": "amount", "max": "5%"}}), {"orders": empty})
    assert rate["status"] == "passed"


def daily(spark, counts):
    """``counts`` rows per day, the last one on the day before as_of."""
    end = date(2024, 3, 15)
    rows = [
        (datetime.combine(end - timedelta(days=len(counts) - i), datetime.min.time()), v)
        for i, (n, v) in enumerate(counts)
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, "updated_at timestamp_ntz, amount double"), datetime(2024, 3, 15, 6)


def test_period_rules(spark):
    table, now = daily(spark, [(10, 1.0), (10, 1.0), (8, 2.0)])
    check = lambda rule: only(contract(rule), {"orders": table}, now)
    drop = check({"volume": {"max_drop": "20%", "period": "day over day"}})
    assert (drop["actual_value"], drop["status"]) == (20.0, "passed")
    drop = check({"volume": {"max_drop": "19%", "period": "day over day"}})
    assert drop["status"] == "failed"
    moved = check({"change": {"max": "50%", "period": "day over day"}})
    assert (moved["actual_value"], moved["status"]) == (60.0, "failed")
    shift = check({"distribution_shift": {"column": "amount", "max": "99%", "period": "day over day"}})
    assert (shift["actual_value"], shift["status"]) == (100.0, "failed")
    trail = check({"trailing_average": {"max": "60%", "days": 30}})
    assert (trail["actual_value"], trail["status"]) == (60.0, "passed")
    floor = check({"row_count": {"min": 28}})
    assert (floor["actual_value"], floor["status"]) == (28.0, "failed")


def test_growth_passes_volume(spark):
    table, now = daily(spark, [(5, 1.0), (50, 1.0)])
    rule = {"volume": {"max_drop": "10%", "period": "day over day"}}
    row = only(contract(rule), {"orders": table}, now)
    assert (row["actual_value"], row["status"]) == (-900.0, "passed")


def test_volume_of_another_table(spark, orders):
    table, now = daily(spark, [(5, 1.0), (2, 1.0)])
    rule = {"volume": {"table": "other", "max_drop": "10%", "period": "day over day"}}
    row = only(contract(rule), {"orders": orders, "other": table}, now)
    assert (row["actual_value"], row["status"]) == (60.0, "failed")


def test_series_checks(spark):
    table, _ = daily(spark, [(10, 1.0), (10, 1.0), (6, 1.0), (12, 5.0)])
    series = checks.per_period(table, "updated_at", "day", "amount").cache()
    by = lambda frame, c: [r[c] for r in frame.orderBy("period").collect()]
    volume = checks.volume_series(series, 20)
    assert by(volume, "drop_pct") == [None, 0.0, 40.0, -100.0]
    assert by(volume, "status") == ["passed", "passed", "failed", "passed"]
    median = checks.volume_median_series(series)
    assert by(median, "median") == [None, 10.0, 10.0, 10.0]
    assert by(median, "status") == ["passed", "passed", "failed", "passed"]
    assert by(checks.change_series(series, 100), "status") == ["passed", "passed", "passed", "failed"]
    assert by(checks.change_series(series, 10, "mean"), "change_pct") == [None, 0.0, 0.0, 400.0]
    trail = checks.trailing_average_series(series, 50, 2)
    assert by(trail, "trailing_avg") == [None, 10.0, 10.0, 8.0]


def test_duplicate_rate(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    row = checks.duplicate_rates(rows, "k").first()
    assert (row["row_count"], row["distinct_count"]) == (3, 2)
    assert row["duplicate_pct"] == pytest.approx(100 / 3)


def test_schema_drift(spark, orders):
    before = checks.schema_snapshot(orders, "m", 1)
    changed = orders.drop("refund").withColumn("amount", F.col("amount").cast("string")).withColumn(
        "channel", F.lit("web")
    )
    history = before.unionByName(checks.schema_snapshot(changed, "m", 2))
    drift = {(r["column_name"], r["change"]) for r in checks.schema_drift(history).collect()}
    assert drift == {("refund", "removed"), ("amount", "retyped"), ("channel", "added")}
    prints = checks.fingerprint(history).collect()
    assert len({r["fingerprint"] for r in prints}) == 2

    rule = contract({"schema_drift": {}})
    row = checks.evaluate([rule], {"orders": changed}, fx.NOW, before).first()
    assert (row["actual_value"], row["status"]) == (3.0, "failed")
    assert checks.evaluate([rule], {"orders": orders}, fx.NOW, before).first()["status"] == "passed"
    assert checks.evaluate([rule], {"orders": orders}, fx.NOW).first()["status"] == "passed"


def test_score_and_summary(spark):
    rows = [("a", "passed")] * 6 + [("a", "warning"), ("b", "error"), ("b", "passed"), ("c", "passed")]
    results = spark.createDataFrame(rows, "metric string, status string")
    scores = suite.metric_scores(results)
    got = {r["metric"]: (r["trust_score"], r["trust_total"], r["status"], r["scorecard"]) for r in scores.collect()}
    assert got == {
        "a": (6.5, 7, "warning", "PASS"),
        "b": (1.0, 2, "error", "FAIL"),
        "c": (1.0, 1, "passed", "PASS"),
    }
    summary = suite.suite_summary(scores).first()
    assert tuple(summary) == (3, 1, 1, 1, 1)
    calm = suite.suite_summary(scores.filter("metric <> 'b'")).first()
    assert calm["exit_code"] == 0


def test_rule_and_catalog_rows(spark):
    wanted = contract({"range": {"min": "0.5%", "max": "20%"}}, owner="x", description="d")
    row = rules.rule_rows(spark, [wanted]).first()
    assert (row["rule_type"], row["min"], row["max"], row["table_name"]) == ("range", 0.5, 20.0, "orders")
    assert rules.catalog_rows(spark, [wanted]).first()["rules"] == 1
