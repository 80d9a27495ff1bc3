"""Every registered query against its SQL form, values and types, on the small tables."""

import compare
import pytest

from martwright.plans import REGISTRY

ROOT = "/root/testdata/sf0.001"

# Operators Spark runs row by row in Python or as all-pairs products.
UNWANTED = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "FlatMapGroupsInPandas",
)


@pytest.fixture(scope="module")
def duck():
    return compare.connect(ROOT)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_same_as_sql(spark, duck, name):
    query = REGISTRY[name]
    frame = query.build(spark, ROOT)
    assert query.sql is not None
    assert compare.spark_rows(frame) == compare.duck_rows(duck, query.sql)
    assert compare.type_differences(frame, duck, query.sql) == []
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert [word for word in UNWANTED if word in plan] == []


def scanned(frame):
    return [
        line
        for line in frame._jdf.queryExecution().executedPlan().toString().split("\n")
        if "FileScan" in line
    ]


def test_filters_and_columns_reach_the_scan(spark):
    (scan,) = scanned(REGISTRY["mart_daily_revenue"].build(spark, ROOT))
    assert "EqualTo(o_orderstatus,F)" in scan
    assert "o_orderpriority" not in scan.split("ReadSchema")[1]
    (scan,) = scanned(REGISTRY["metric_filtered"].build(spark, ROOT))
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01" in scan
    assert "In(o_orderpriority" in scan


def test_one_scan_per_table_for_a_contract(spark):
    """Ten rules on events: one scan for the aggregates and one for the duplicate rate."""
    scans = [s for s in scanned(REGISTRY["contract_suite"].build(spark, ROOT)) if "events" in s]
    assert len(scans) == 2


def test_four_definitions_share_their_scans(spark):
    """Orders and refunds once; the comparison reads the orders in scope once more, to leave
    the refunds of all other orders before they are summed."""
    scans = scanned(REGISTRY["definition_compare"].build(spark, ROOT))
    assert sum("l_orderkey" in s for s in scans) == 1
    assert sum("o_orderkey" in s for s in scans) == 2
    assert len(scans) == 3
    assert len(scanned(REGISTRY["definition_gap"].build(spark, ROOT))) == 2


@pytest.mark.parametrize("name, tables", [("table_inventory", 14), ("ingest_health", 2)])
def test_row_counts_come_from_footers(spark, name, tables):
    plan = REGISTRY[name].build(spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") == tables


def final_plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


@pytest.mark.parametrize("name", ["revision_dedup", "history_last_n", "issue_drafts"])
def test_rank_filters_run_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in final_plan(REGISTRY[name].build(spark, ROOT))


@pytest.mark.parametrize(
    "name, table", [("mart_customer_ltv", "o_custkey"), ("gmv", "l_orderkey"), ("def_aligned", "l_orderkey")]
)
def test_hot_keys_are_combined_before_they_are_shuffled(spark, name, table):
    """The scan of the large table is followed by a partial aggregate below the exchange."""
    lines = final_plan(REGISTRY[name].build(spark, ROOT)).split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and table in line)
    above = [line for line in lines[:scan] if "Exchange" in line or "partial_" in line]
    assert "partial_" in above[-1]


def test_entry_has_one_row_per_test(spark):
    import __spark_entry__ as contract

    assert {r["name"] for r in contract.entry(spark).collect()} >= {"events_not_empty", "mart_broken"}
    assert set(REGISTRY) <= set(contract.queries())
    assert set(REGISTRY) <= set(contract.oracle_sql()) <= set(contract.queries())
