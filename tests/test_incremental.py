"""Marts kept up to date from changes against marts built anew; merges by folder."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from martwright.operators import incremental
from martwright.operators.incremental import Mart, Measure
from martwright.session import scratch_dir
from martwright.sources.files import stamp_loaded
from martwright.sources.load import SIGN, SchemaMismatch, load, stored_rows

AS_OF = datetime(2024, 3, 1)
SCHEMA = "order_id long, customer_id long, status string, amount double, order_at timestamp_ntz"
MART = Mart(
    {"customer_id": "customer_id"},
    (
        Measure("orders", "count", "order_id"),
        Measure("paid", "sum", "case when status = 'paid' then amount end"),
        Measure("newest", "max", "order_at"),
        Measure("oldest", "min", "order_at"),
    ),
)


def anew(base, mart=MART):
    """The mart by one pass over the whole base table."""
    kinds = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    out = []
    for m in mart.measures:
        made = kinds[m.kind](m.name)
        out.append((F.coalesce(made, F.lit(0)) if m.kind == "sum" else made).alias(m.name))
    rows = mart.rows(base).groupBy(*mart.keys).agg(F.count(F.lit(1)).alias("_rows"), *out)
    return sorted(map(tuple, rows.collect()), key=str)


def kept(spark, path, mart=MART, buckets=4):
    return sorted(map(tuple, incremental.mart_rows(spark, path, mart, buckets).collect()), key=str)


def order(draw, key):
    return (
        key,
        draw.choice([None, 1, 1, 1, 2, 3]),
        draw.choice(["paid", "open", None]),
        draw.choice([None, 0.1, 12.34, 99.99]),
        draw.choice([None, *[AS_OF + timedelta(days=d) for d in range(6)]]),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_loads_gives_the_mart_built_anew(spark, seed):
    draw, folder = random.Random(seed), scratch_dir(spark, "test_incremental")
    base, next_key = f"{folder}/base", 0
    for number in range(1, 6):
        mode = draw.choice(["append", "merge"])
        fresh = [order(draw, next_key + i) for i in range(draw.randint(0, 6))]
        next_key += len(fresh)
        again = [order(draw, draw.randrange(next_key)) for _ in range(8)] if next_key and mode == "merge" else []
        rows = spark.createDataFrame(fresh + again, SCHEMA)
        log = f"{folder}/changes/{number}"
        at = AS_OF + timedelta(hours=number)
        load(stamp_loaded(rows, at), base, mode, ["order_id"], ["amount", "status", "customer_id", "order_at"],
             buckets=4, changes=log)
        changes = spark.read.parquet(log)
        for _ in range(draw.choice([1, 2])):  # a batch that is applied again counts once
            incremental.refresh(f"{folder}/mart", MART, changes, number, lambda: stored_rows(spark, base), 4)
        if next_key:
            assert kept(spark, f"{folder}/mart") == anew(stored_rows(spark, base))


def loaded(spark, rows, folder, mode, hour, **more):
    at = AS_OF + timedelta(hours=hour)
    return load(stamp_loaded(spark.createDataFrame(rows, SCHEMA), at), f"{folder}/base", mode, ["order_id"], **more)


def files(spark, path):
    return {f.split("/base/")[-1].split("/mart/")[-1] for f in spark.read.parquet(path).inputFiles()}


def test_other_folders_stay_as_they_are(spark):
    folder = scratch_dir(spark, "test_folders")
    rows = [(i, i, "paid", 1.0, AS_OF) for i in range(200)]
    loaded(spark, rows, folder, "merge", 1, buckets=16, changes=f"{folder}/c1")
    base = lambda: stored_rows(spark, f"{folder}/base")
    assert incremental.refresh(f"{folder}/mart", MART, spark.read.parquet(f"{folder}/c1"), 1, base, 16) == 16
    state = f"{folder}/mart/buckets=16"
    before = files(spark, f"{folder}/base"), files(spark, state)
    loaded(spark, [(7, 7, "open", 2.0, AS_OF)], folder, "merge", 2, buckets=16, changes=f"{folder}/c2")
    changes = spark.read.parquet(f"{folder}/c2")
    assert sorted((r["status"], r[SIGN]) for r in changes.collect()) == [("open", 1), ("paid", -1)]
    assert incremental.refresh(f"{folder}/mart", MART, changes, 2, base, 16) == 1
    after = files(spark, f"{folder}/base"), files(spark, state)
    for old, new in zip(before, after, strict=True):
        assert len(old - new) == 1 and len(new - old) == 1
    assert kept(spark, f"{folder}/mart", buckets=16) == anew(base())
    # the scan of the state names the folder of the touched group alone
    bucket = F.col("_bucket").isin([3])
    plan = spark.read.parquet(state).filter(bucket)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan


def test_a_group_is_looked_up_only_when_its_extreme_goes(spark):
    folder = scratch_dir(spark, "test_lookup")
    day = lambda d: AS_OF + timedelta(days=d)
    loaded(spark, [(1, 1, "paid", 1.0, day(1)), (2, 1, "paid", 1.0, day(9)), (3, 2, "paid", 1.0, day(5))],
           folder, "merge", 1, buckets=4, changes=f"{folder}/c1")
    calls = []

    def base():
        calls.append(1)
        return stored_rows(spark, f"{folder}/base")

    incremental.refresh(f"{folder}/mart", MART, spark.read.parquet(f"{folder}/c1"), 1, base, 4)
    loaded(spark, [(2, 2, "paid", 1.0, day(3))], folder, "merge", 2, buckets=4, changes=f"{folder}/c2")
    changes = spark.read.parquet(f"{folder}/c2")
    part = incremental.delta(changes, MART)
    assert {(r["customer_id"], r["_rows"]) for r in part.collect()} == {(1, -1), (2, 1)}
    incremental.refresh(f"{folder}/mart", MART, changes, 2, base, 4)
    assert kept(spark, f"{folder}/mart") == anew(base())
    # the last row of a group goes, and an empty change set changes nothing
    loaded(spark, [(1, 2, "open", None, None)], folder, "merge", 3, buckets=4, changes=f"{folder}/c3")
    incremental.refresh(f"{folder}/mart", MART, spark.read.parquet(f"{folder}/c3"), 3, base, 4)
    assert [r[0] for r in kept(spark, f"{folder}/mart")] == [2]
    assert kept(spark, f"{folder}/mart") == anew(base())
    assert incremental.refresh(f"{folder}/mart", MART, changes.limit(0), 4, base, 4) == 0


def test_bucketed_merge_equals_the_plain_one(spark):
    draw, folder = random.Random(5), scratch_dir(spark, "test_bucketed")
    newest = ["amount", "status", "customer_id", "order_at"]
    for number in range(1, 4):
        rows = [order(draw, draw.randrange(40)) for _ in range(30)]
        at = AS_OF + timedelta(hours=draw.choice([1, 2]))  # older batches come late
        stamped = stamp_loaded(spark.createDataFrame(rows, SCHEMA), at)
        one = load(stamped, f"{folder}/plain", "merge", ["order_id"], newest)
        two = load(stamped, f"{folder}/cut", "merge", ["order_id"], newest, buckets=8)
        assert one.rows_in_table == two.rows_in_table
        plain = sorted(map(tuple, spark.read.parquet(f"{folder}/plain").collect()), key=str)
        assert sorted(map(tuple, stored_rows(spark, f"{folder}/cut").collect()), key=str) == plain


def test_buckets_are_guarded(spark):
    folder = scratch_dir(spark, "test_guard")
    rows = [(i, i, "paid", 1.0, AS_OF) for i in range(50)]
    with pytest.raises(ValueError):
        loaded(spark, rows, folder, "merge", 1, changes=f"{folder}/c")
    with pytest.raises(ValueError):
        loaded(spark, rows, folder, "merge", 1, buckets=4, partition_by=["status"])
    loaded(spark, rows, folder, "replace", 1, buckets=4)
    for other in (5, 32):
        with pytest.raises(SchemaMismatch):
            loaded(spark, rows, folder, "merge", 2, buckets=other)
    with pytest.raises(ValueError):
        Measure("x", "median", "x")
