"""Subscriptions over a calendar, chunked running sums, and differences of tables, by plain versions."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from martwright.functions.ordered import with_running_sum
from martwright.functions.values import month_of
from martwright.operators import metrics, sweep
from martwright.operators.differences import (
    compare_keys,
    differing_leaves,
    difference,
    leaf_digests,
    stored_difference,
)
from martwright.plans import REGISTRY
from martwright.session import scratch_dir
from martwright.sources.files import stamp_loaded
from martwright.sources.load import SchemaMismatch, load

ROOT = "/root/testdata/sf0.001"
SUBSCRIPTION = (
    "subscription_id long, plan_name string, plan_amount double, billing_interval string, status string,"
    " started_at timestamp_ntz, ended_at timestamp_ntz"
)
FIRST, LAST = date(2024, 1, 1), date(2024, 4, 30)


def made(n=300, seed=1, plan=None):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        began = draw.choice([None, *[datetime(2023, 11, 1, 5) + timedelta(days=draw.randrange(200))] * 9])
        ended = None
        if began and draw.random() < 0.7:
            ended = began + timedelta(days=draw.choice([-3, 0, 1, 5, 31, 60]), hours=draw.randrange(24))
        rows.append(
            (
                i,
                plan or draw.choice(["a", "b", "Trial", None]),
                draw.choice([None, 10.0, 33.33, 120.0]),
                draw.choice(["monthly", "annual", "weekly", None]),
                draw.choice(["active", "past_due", "trialing", None]),
                began,
                ended,
            )
        )
    return rows


def plain_days(rows):
    spans = [(r, r[5].date(), r[6].date() if r[6] else None) for r in rows if r[5]]
    spans = [s for s in spans if s[2] is None or s[2] > s[1]]
    out = {}
    for plan in {s[0][1] for s in spans}:
        day = FIRST
        while day <= LAST:
            on = [r for r, a, b in spans if r[1] == plan and a <= day and (b is None or b > day)]
            pays = [
                r for r in on
                if r[4] in ("active", "past_due") and r[3] in ("monthly", "annual") and plan not in (None, "Trial")
            ]
            mrr = [sum(round(100 * (r[2] or 0)) for r in pays if r[3] == k) / 100 for k in ("monthly", "annual")]
            out[plan, day] = (len(on), pytest.approx(mrr[0] + mrr[1] / 12))
            day += timedelta(days=1)
    return out


def test_days_equal_a_walk_over_the_calendar(spark):
    rows = made()
    found = sweep.active_by_day(spark.createDataFrame(rows, SUBSCRIPTION), FIRST, LAST).collect()
    assert {(r["plan"], r["day"]): (r["active"], r["mrr"]) for r in found} == plain_days(rows)
    assert len(found) == 4 * 121
    whole = sweep.active_by_day(spark.createDataFrame(rows, SUBSCRIPTION), FIRST, LAST, by_plan=False).collect()
    per_day = {}
    for r in found:
        per_day[r["day"]] = per_day.get(r["day"], 0) + r["active"]
    assert {r["day"]: r["active"] for r in whole} == per_day
    assert sweep.active_by_day(spark.createDataFrame([], SUBSCRIPTION), FIRST, LAST).collect() == []


def test_months_equal_the_churn_of_each_month(spark):
    table = spark.createDataFrame(made(200, 2), SUBSCRIPTION)
    found = {r["month"]: r for r in sweep.churn_by_month(table, FIRST, date(2024, 4, 1)).collect()}
    assert len(found) == 4
    for month, row in found.items():
        assert row == metrics.churn_rate(table, month).first()
    empty = sweep.churn_by_month(spark.createDataFrame([], SUBSCRIPTION), FIRST, date(2024, 2, 1)).collect()
    assert [(r["active_at_start"], r["churned"], r["churn_pct"]) for r in empty] == [(0, 0, None)] * 2


def test_no_row_meets_the_calendar_and_hot_plans_are_combined_first(spark):
    table = spark.createDataFrame(made(2000, 3, plan="hot"), SUBSCRIPTION).repartition(8)
    frame = sweep.active_by_day(table, FIRST, LAST)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    steps = [line for line in plan.split("\n") if "partial_sum" in line and "sign" in line]
    assert steps


def test_running_sums_over_coarser_chunks(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["x", None]), date(2020, 1, 1) + timedelta(days=i), draw.randint(-5, 9)) for i in range(900)]
    table = spark.createDataFrame(rows, "k string, day date, v long").repartition(5)
    found = with_running_sum(
        table, ["k"], "day", {"one": F.col("v"), "two": F.lit(1)}, [F.trunc("day", "week"), month_of("day"), F.trunc("day", "year")]
    ).collect()
    so_far, want = {}, {}
    for k, day, v in rows:
        a, b = so_far.get(k, (0, 0))
        so_far[k] = (a + v, b + 1)
        want[k, day] = so_far[k]
    # weeks run over the ends of months: the coarse chunk of a fine one is that of its last day
    assert {(r["k"], r["day"]): (r["one"], r["two"]) for r in found} == want
    assert set(found[0].asDict()) == {"k", "day", "v", "one", "two"}


# -- differences


def tables(spark, seed=1, n=400):
    draw = random.Random(seed)
    value = lambda: draw.choice([None, 0.0, -0.0, 1.5, float("nan")])
    left = {i: (i, draw.choice([None, "a", "b", ""]), value()) for i in range(n)}
    right = dict(left)
    for i in draw.sample(range(n), 12):
        right[i] = (i, draw.choice([None, "c", ""]), value())
    for i in draw.sample(range(n), 5):
        right.pop(i)
    right |= {n + i: (n + i, "new", 1.0) for i in range(3)}
    schema = "id long, a string, b double"
    l, r = list(left.values()), list(right.values())
    draw.shuffle(r)
    return spark.createDataFrame(l, schema).repartition(3), spark.createDataFrame(r, schema).repartition(5), left, right


def plain_difference(left, right):
    same = lambda x, y: (x is None) == (y is None) and (x is None or x == y or (x != x and y != y))
    out = set()
    for i in left.keys() | right.keys():
        if i not in right:
            out.add((i, "left only", ()))
        elif i not in left:
            out.add((i, "right only", ()))
        else:
            changed = tuple(c for c, x, y in zip("ab", left[i][1:], right[i][1:], strict=True) if not same(x, y))
            if changed:
                out.add((i, "changed", changed))
    return out


@pytest.mark.parametrize("leaves, fan", [(256, 16), (64, 4), (16, 16)])
def test_differences_equal_a_plain_comparison(spark, leaves, fan):
    left, right, l, r = tables(spark, leaves)
    found = difference(left, right.select("b", "id", "a"), ["id"], leaves, fan)
    assert {(x["id"], x["side"], tuple(x["columns"])) for x in found.rows.collect()} == plain_difference(l, r)
    whole = compare_keys(left, right, ["id"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, found.rows.collect()))


def test_only_children_of_differing_nodes_are_compared(spark):
    left, right, *_ = tables(spark)
    one, two = (leaf_digests(t, ["id"], 256) for t in (left, right))
    assert differing_leaves(one, one, 256) == []
    lists = [{r["leaf"]: tuple(r)[1:] for r in d.collect()} for d in (one, two)]
    want = sorted(k for k in lists[0].keys() | lists[1].keys() if lists[0].get(k) != lists[1].get(k))
    assert differing_leaves(one, two, 256) == want
    assert difference(left, left, ["id"]).rows.collect() == []


def test_second_read_takes_the_folders_that_differ(spark):
    folder = scratch_dir(spark, "test_difference")
    rows = [(i, f"text {i} " * 20) for i in range(3000)]
    for name, change in (("left", None), ("right", 17)):
        table = spark.createDataFrame([(i, "other" if i == change else t) for i, t in rows], "id long, t string")
        load(stamp_loaded(table, datetime(2024, 1, 1)), f"{folder}/{name}", "replace", ["id"], buckets=16)
    found = stored_difference(spark, f"{folder}/left", f"{folder}/right", ["id"], 16)
    assert [(r["id"], r["side"], r["columns"]) for r in found.rows.collect()] == [(17, "changed", ["t"])]
    assert len(found.leaves) == 1
    assert 0 < found.bytes_read < found.bytes_stored / 12
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(_bucket") + plan.count("PartitionFilters: [(_bucket") >= 1
    with pytest.raises(ValueError):
        stored_difference(spark, f"{folder}/left", f"{folder}/right", ["id"], 10, 256)


def test_odd_tables_differ_as_bags(spark):
    schema = "k string, v int"
    one = spark.createDataFrame([(None, 1), ("a", 1), ("a", 1), ("b", 2)], schema)
    two = spark.createDataFrame([(None, 1), ("a", 1), ("b", 2), ("b", 2)], schema)
    found = {r["k"]: (r["side"], r["left_rows"], r["right_rows"], r["columns"]) for r in difference(one, two, ["k"]).rows.collect()}
    assert found == {"a": ("changed", 2, 1, []), "b": ("changed", 1, 2, [])}
    none = spark.createDataFrame([], schema)
    assert difference(none, none, ["k"]).rows.collect() == []
    assert {r["side"] for r in difference(one, none, ["k"]).rows.collect()} == {"left only"}
    with pytest.raises(SchemaMismatch):
        difference(one, two.withColumn("w", F.lit(1)), ["k"])


def test_carts_and_days_are_registered_with_sql():
    for name in ("stream_abandoned", "subscriptions_by_day", "churn_by_month", "table_difference"):
        assert REGISTRY[name].sql
