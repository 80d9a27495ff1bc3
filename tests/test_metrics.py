"""Marts, revenue definitions and business metrics on hand-made rows."""

from datetime import date, datetime

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from martwright.functions.values import scaled
from martwright.operators import marts, metrics, revenue


@pytest.fixture
def alignment(spark):
    return (
        spark.createDataFrame(fx.ALIGNMENT, fx.ALIGNMENT_SCHEMA),
        spark.createDataFrame(fx.REFUNDS, fx.REFUNDS_SCHEMA),
        fx.MARCH,
        fx.REPORT_DAY,
    )


GOLDEN = {
    "engineering": 4_400_000.0,
    "analytics": 3_800_000.0,
    "finance": 2_750_000.0,
    "aligned": 3_250_000.0,
}


@pytest.mark.parametrize("definition", revenue.DEFINITIONS, ids=lambda d: d.name)
def test_definitions(alignment, definition):
    orders, refunds, month, as_of = alignment
    value = revenue.monthly_revenue(orders, refunds, definition, month, as_of).first()[0]
    assert value == GOLDEN[definition.name]


def test_compare_and_gap_add_up(alignment):
    rows = revenue.definition_compare(*alignment).collect()
    assert {r["definition"]: r["monthly_revenue"] for r in rows} == GOLDEN
    delta = {r["definition"]: r["delta_to_aligned"] for r in rows}
    gap = revenue.definition_gap(*alignment).collect()
    reasons = {(r["definition"], r["reason"]): r["delta"] for r in gap}
    assert reasons == {
        ("engineering", "status"): 600_000.0,
        ("engineering", "currency"): 300_000.0,
        ("engineering", "refunds"): 250_000.0,
        ("analytics", "currency"): 300_000.0,
        ("analytics", "period"): 250_000.0,
        ("finance", "settlement"): -500_000.0,
    }
    for name in ("engineering", "analytics", "finance"):
        assert sum(v for (d, _), v in reasons.items() if d == name) == delta[name]


def test_no_order_is_null_not_zero(alignment):
    orders, refunds, _, _ = alignment
    empty = revenue.monthly_revenue(orders, refunds, revenue.ALIGNED, date(2020, 1, 1), fx.REPORT_DAY)
    assert empty.first()[0] is None


def test_many_refunds_of_one_order_do_not_multiply_it(spark, alignment):
    orders, _, month, as_of = alignment
    refunds = spark.range(1000).select(
        F.lit("O-001").alias("order_id"), F.lit(1.5).alias("refund_amount")
    )
    value = revenue.monthly_revenue(orders, refunds, revenue.ALIGNED, month, as_of).first()[0]
    assert value == 3_500_000.0 - 1500.0


def test_membership(alignment):
    orders, _, month, as_of = alignment
    sides = [
        revenue.qualifying(orders, d, month, as_of) for d in (revenue.ENGINEERING, revenue.ANALYTICS)
    ]
    found = {r["order_id"]: r["side"] for r in revenue.membership(*sides, ["order_id"]).collect()}
    assert found["O-007"] == "left only"
    assert found["O-008"] == "right only"
    assert found["O-001"] == "both"
    assert "O-006" not in found


@pytest.fixture
def shop(spark):
    at = datetime.fromisoformat
    orders = spark.createDataFrame(
        [
            (1, "a", "paid", 10.10, at("2024-01-01 09:00:00")),
            (2, "a", "refunded", 5.00, at("2024-01-03 09:00:00")),
            (3, "b", "paid", 20.20, at("2024-01-01 23:59:59")),
            (4, "b", "paid", 30.30, at("2024-01-02 00:00:00")),
            (5, "b", None, 99.0, at("2024-01-02 10:00:00")),
        ],
        "order_id int, customer_id string, status string, amount double, order_at timestamp_ntz",
    )
    customers = spark.createDataFrame(
        [("a", "Ann", "X"), ("b", "Bo", "Y"), ("c", "Cy", None)],
        "customer_id string, name string, country string",
    )
    return customers, scaled(orders, "amount", 2)


def test_marts(shop):
    customers, orders = shop
    daily = marts.daily_revenue(orders, fx.NOW)
    assert [(str(r["day"]), r["order_count"], r["revenue"]) for r in daily.orderBy("day").collect()] == [
        ("2024-01-01", 2, 30.3),
        ("2024-01-02", 1, 30.3),
    ]
    kpis = marts.dashboard_kpis(scaled(daily, "revenue", 2)).first()
    assert (kpis["total_revenue"], kpis["total_orders"], kpis["avg_daily_revenue"]) == (60.6, 3, 30.3)
    ltv = {r["customer_id"]: r for r in marts.customer_ltv(customers, orders, fx.NOW).collect()}
    assert (ltv["a"]["lifetime_orders"], ltv["a"]["lifetime_revenue"]) == (2, 10.1)
    assert (ltv["c"]["lifetime_orders"], ltv["c"]["lifetime_revenue"]) == (0, 0.0)
    assert ltv["c"]["last_order_at"] is None
    top = marts.top_customers(marts.customer_ltv(customers, orders, fx.NOW), 2).collect()
    assert [r["name"] for r in top] == ["Bo", "Ann"]


def test_period_change_of_a_zero_baseline(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 10.0)], "period int, value double")
    changed = marts.period_change(rows).orderBy("period").collect()
    assert [r["change_pct"] for r in changed] == [None, 0.0, 100.0]


def test_budget(spark):
    rows = spark.createDataFrame(
        [(100.0, 90.0), (50.0, 60.5), (None, 5.0), (7.0, None)], "budgeted double, spent double"
    )
    got = marts.budget_utilisation(rows).first()
    assert (got["spent"], got["budgeted"], got["lines"], got["overspent_lines"]) == (150.5, 150.0, 2, 1)


def test_recurring_revenue(spark):
    subs = spark.createDataFrame(fx.SUBSCRIPTIONS, fx.SUBSCRIPTIONS_SCHEMA)
    stored = metrics.recurring_revenue(subs, annual_is_monthly_equiv=True)
    assert stored.agg(F.round(F.sum("mrr"), 2)).first()[0] == 1747.92
    divided = metrics.recurring_revenue(subs, by_plan=False).first()
    assert (divided["subscriptions"], round(divided["mrr"], 2)) == (15, 1436.33)
    assert "trial" not in {r["plan"] for r in stored.collect()}


def test_churn(spark):
    subs = spark.createDataFrame(fx.SUBSCRIPTIONS, fx.SUBSCRIPTIONS_SCHEMA).withColumn(
        "ended_at",
        metrics.ended_at(F.col("status"), F.col("canceled_at"), F.col("current_period_end")),
    )
    row = metrics.churn_rate(subs, date(2025, 3, 1)).first()
    assert (row["active_at_start"], row["churned"]) == (18, 3)
    assert round(row["churn_pct"], 2) == 16.67
    # sub_008 began on February 1: one full month, not two; sub_006 began on January 10.
    assert metrics.churn_rate(subs, date(2025, 3, 1), 1).first()["active_at_start"] == 18
    assert metrics.churn_rate(subs, date(2025, 3, 1), 2).first()["active_at_start"] == 16


def test_conversion_abandonment_and_active_users(spark):
    at = datetime.fromisoformat
    events = spark.createDataFrame(
        [
            (1, "view", at("2024-01-01 10:00:00")),
            (1, "view", at("2024-01-01 11:00:00")),
            (1, "signup", at("2024-01-01 12:00:00")),
            (2, "click", at("2024-01-01 10:00:00")),
            (3, "view", at("2024-01-02 10:00:00")),
            (None, "view", at("2024-01-02 10:00:00")),
            (4, "signup", at("2024-01-02 10:00:00")),
        ],
        "user_id int, event_type string, ts timestamp_ntz",
    )
    kind = lambda t: events.filter((F.col("event_type") == t) & F.col("user_id").isNotNull())
    rate = metrics.conversion_rate(kind("view"), kind("signup"), "user_id").first()
    assert (rate["total"], rate["matched"], rate["conversion_pct"]) == (2, 1, 50.0)
    assert [r[0] for r in metrics.converted(kind("view"), kind("signup"), "user_id").collect()] == [1]
    assert [r[0] for r in metrics.abandoned(kind("view"), kind("signup"), "user_id").collect()] == [3]
    active = metrics.daily_active_users(events, ["view", "click"]).orderBy("day").collect()
    assert [r["dau"] for r in active] == [2, 1]
    assert metrics.signups_on(events, date(2024, 1, 2)).first()["signups"] == 1

    carts = spark.createDataFrame(
        [(1, at("2024-01-01 12:00:00"), 2), (2, at("2024-01-01 13:00:00"), 1), (3, at("2024-01-01 13:00:00"), 0),
         (4, at("2023-12-30 13:00:00"), 1)],
        "cart_id int, created_at timestamp_ntz, items int",
    )
    checkouts = spark.createDataFrame([(1,), (1,)], "cart_id int")
    row = metrics.cart_abandonment(carts, checkouts, datetime(2024, 1, 2)).first()
    assert (row["carts"], row["abandoned"], row["abandonment_pct"]) == (2, 1, 50.0)


def test_first_order_and_order_conversion(shop, spark):
    _, orders = shop
    first = {r["customer_id"]: r["order_id"] for r in metrics.first_order(orders).collect()}
    assert first == {"a": 1, "b": 3}
    sessions = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "customer_id string")
    row = metrics.order_conversion(sessions, orders, "customer_id", "paid").first()
    assert (row["total"], row["matched"], row["conversion_pct"]) == (3, 2, 66.67)


def test_aov_and_gmv(shop, spark):
    _, orders = shop
    assert metrics.average_order_value(orders, "paid").first()["aov"] == 20.2
    invoices = spark.createDataFrame(
        [(1, "finalized", 10.0, 1.0), (1, "finalized", 5.0, 0.5), (1, "void", 7.0, 0.0), (2, "finalized", 9.0, 0.0)],
        "order_id int, invoice_status string, net_amount double, tax double",
    )
    row = metrics.merchandise_revenue(orders, invoices, "paid").first()
    assert (row["orders"], row["gmv"]) == (1, 16.5)


def test_retention(spark):
    at = datetime.fromisoformat
    rows = spark.createDataFrame(
        [
            ("up", 100.0, at("2023-05-10")), ("up", 150.0, at("2024-05-10")),
            ("down", 100.0, at("2023-05-10")), ("down", 60.0, at("2024-05-20")),
            ("gone", 50.0, at("2023-05-31")),
            ("new", 500.0, at("2024-05-01")),
        ],
        "customer_id string, amount double, order_at timestamp_ntz",
    )
    row = metrics.revenue_retention(rows, date(2024, 5, 1)).first()
    assert (row["customers"], row["starting"], row["ending"]) == (3, 250.0, 210.0)
    assert (row["expansion"], row["contraction"], row["churned"]) == (50.0, 40.0, 50.0)
    assert row["nrr_pct"] == 84.0
    assert row["starting"] + row["expansion"] - row["contraction"] - row["churned"] == row["ending"]


def test_response_time(spark):
    at = datetime.fromisoformat
    tickets = spark.createDataFrame(
        [(1, at("2024-01-10 10:00:00")), (2, at("2024-01-10 10:00:00")), (3, at("2024-01-10 10:00:00")),
         (4, at("2023-01-10 10:00:00"))],
        "ticket_id int, opened_at timestamp_ntz",
    )
    answers = spark.createDataFrame(
        [(1, at("2024-01-10 10:10:00")), (1, at("2024-01-10 10:04:00")), (1, at("2024-01-10 09:00:00")),
         (2, at("2024-01-10 10:30:30")), (4, at("2023-01-10 10:01:00"))],
        "ticket_id int, responded_at timestamp_ntz",
    )
    row = metrics.response_time_p50(tickets, answers, datetime(2024, 1, 31)).first()
    assert row["p50_minutes"] == (4 + 30.5) / 2


@pytest.fixture
def rates(spark):
    day = date.fromisoformat
    return spark.createDataFrame(
        [("EUR", day("2024-01-05"), 1.1), ("EUR", day("2024-01-08"), 1.2), ("GBP", day("2024-01-06"), 1.3)],
        "currency string, rate_day date, rate double",
    ).withColumn("rate", F.col("rate").cast("decimal(10,4)"))


def test_usd_revenue_carries_the_last_rate(spark, rates):
    day = date.fromisoformat
    invoices = spark.createDataFrame(
        [("EUR", day("2024-01-04"), 10.0), ("EUR", day("2024-01-05"), 10.0), ("EUR", day("2024-01-07"), 10.0),
         ("EUR", day("2024-01-20"), 10.0), ("USD", day("2024-01-01"), 5.0)],
        "currency string, day date, amount double",
    )
    refunds = spark.createDataFrame(
        [("EUR", day("2024-01-07"), 4.0)], "currency string, day date, amount double"
    )
    got = {r["currency"]: r for r in metrics.usd_revenue(invoices, refunds, rates).collect()}
    assert got["EUR"]["net_usd"] == pytest.approx(10 * 1.1 + 6 * 1.1 + 10 * 1.2)
    assert (got["EUR"]["net_local"], got["EUR"]["unconverted"]) == (36.0, 1)
    assert (got["USD"]["net_usd"], got["USD"]["unconverted"]) == (5.0, 0)

    rows = metrics.convert_at_rate(invoices, rates, "currency", "day", "amount")
    by_day = {str(r["day"]): r["rate"] for r in rows.collect() if r["currency"] == "EUR"}
    assert {k: v and float(v) for k, v in by_day.items()} == {
        "2024-01-04": None, "2024-01-05": 1.1, "2024-01-07": 1.1, "2024-01-20": 1.2,
    }
