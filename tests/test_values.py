"""Sums, merges, suites and helpers at the edges: digits, order, skew, failures."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from martwright.functions.ordered import with_previous
from martwright.functions.percentiles import exact_percentile
from martwright.functions.skew import salted_join
from martwright.functions.values import scaled, total
from martwright.operators import checks, data_tests, history, lineage, marts, semantic
from martwright.operators.rules import rules_of
from martwright.sources import inventory
from martwright.sources.load import csv_files, existing, load, run_ingest, transform_sql

AT = datetime(2024, 1, 31)
TIME = "timestamp_ntz"


def amounts(spark, values):
    rows = [(i, datetime(2024, 1, 30, 1), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id int, at timestamp_ntz, amount double").repartition(3)


def test_small_amounts_keep_their_digits(spark):
    df = amounts(spark, [0.004] * 1000)
    day = checks.per_period(df, "at", "day", "amount").first()
    assert (day.value, day.mean) == (pytest.approx(4.0), pytest.approx(0.004))
    run = history.run_snapshot(df, "m", "amount", ["amount"], AT).first()
    assert run.value_sum == pytest.approx(4.0)
    assert run.column_means_json == '{"amount":"0.0040"}'
    got = semantic.metric_value(df, "amount", "at", "yesterday", AT.date()).first()
    assert got.value == pytest.approx(4.0)


def test_large_amounts_do_not_overflow(spark):
    df = amounts(spark, [4e14] * 3)
    for frame in (df, scaled(df, "amount", 2), scaled(df, "amount", 4)):
        budget = frame.withColumnRenamed("amount", "spent").withColumn("budgeted", F.col("spent"))
        assert marts.budget_utilisation(budget).first().spent == 1.2e15


def test_stated_scale_is_exact_and_spoiled_values_show(spark):
    df = scaled(amounts(spark, [0.1, 0.2, -0.3, 1e12, -1e12] * 20_000), "amount", 1)
    assert df.agg(total(df, "amount").alias("t")).first().t == 0.0
    odd = scaled(amounts(spark, [1.0, float("nan")]), "amount", 2)
    assert str(odd.agg(total(odd, "amount").alias("t")).first().t) == "nan"
    kept = odd.agg(total(odd, "amount", F.col("id") == 0).alias("t")).first().t
    assert kept == 1.0
    assert df.limit(0).agg(total(df, "amount").alias("t")).first().t is None


def test_nan_is_an_error_not_the_end(spark):
    contract = {
        "metric": "m",
        "table": "t",
        "time_column": "at",
        "digits": 2,
        "trust": [{"range": {"column": "amount", "min": 0, "max": 10}}],
    }
    table = amounts(spark, [1.0, float("nan")])
    assert [r.status for r in checks.evaluate([contract], {"t": table}, AT).collect()] == ["error"]


def stamped(spark, rows):
    return spark.createDataFrame(rows, f"k int, v string, _loaded_at {TIME}")


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
@pytest.mark.parametrize("parts", [None, ["k"]])
def test_merge_keeps_the_newest_in_any_order(spark, tmp_path, order, parts):
    path = f"{tmp_path}/t"
    batches = [
        [(1, "old", datetime(2024, 1, 1)), (2, "only", datetime(2024, 1, 1))],
        [(1, "new", datetime(2024, 1, 2)), (None, "null", datetime(2024, 1, 2))],
    ]
    for i in order:
        load(stamped(spark, batches[i]), path, "merge", ["k"], partition_by=parts)
    got = {(r.k, r.v) for r in spark.read.parquet(path).collect()}
    assert got == {(1, "new"), (2, "only"), (None, "null")}


def test_failed_merge_leaves_the_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    load(stamped(spark, [(1, "a", AT), (2, "b", AT)]), path, "merge", ["k"])
    bad = stamped(spark, [(1, "x", AT)]).withColumn(
        "v", F.when(F.col("k") == 1, F.raise_error(F.lit("broken"))).otherwise("x").cast("string")
    )
    with pytest.raises(Exception, match="broken"):
        load(bad, path, "merge", ["k"])
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "b")}
    (tmp_path / "t").rename(tmp_path / "t__aside")
    assert existing(spark, path).count() == 2


def test_suite_survives_a_test_that_fails_while_running(spark):
    spark.range(3).createOrReplaceTempView("numbers_of_suite")
    got = data_tests.data_test_suite(
        spark,
        [(spark.range(3).toDF("id"), [data_tests.expect_key("key", "id")])],
        {
            "divides": "SELECT 1 FROM numbers_of_suite WHERE 1 / (id - id) > 0",
            "finds": "SELECT * FROM numbers_of_suite WHERE id > 0",
            "unknown": "SELECT nothing FROM numbers_of_suite",
        },
    ).collect()
    spark.catalog.dropTempView("numbers_of_suite")
    assert {r.name: (r.status, r.problem_rows) for r in got} == {
        "key": ("passed", 0),
        "divides": ("error", None),
        "finds": ("failed", 2),
        "unknown": ("error", None),
    }


def test_incremental_unless_backfill(spark, tmp_path):
    rows = [(1, "2024-01-30T00:00:00"), (2, "2023-06-01T00:00:00")]
    spark.createDataFrame(rows, "id int, at string").write.option("header", True).csv(
        f"{tmp_path}/in"
    )
    spec = {
        "source": {"type": "csv", "path": f"{tmp_path}/in", "since_column": "at"},
        "target": {"table": "raw", "mode": "replace"},
        "columns": [{"name": "id", "type": "INTEGER"}, {"name": "at", "type": "TIMESTAMP"}],
    }
    assert run_ingest(spark, spec, str(tmp_path), AT).rows_in_table == 1
    assert run_ingest(spark, spec, str(tmp_path), AT, backfill=True).rows_in_table == 2


def test_csv_discovery_and_sql_transform(spark, tmp_path):
    for name in ("b", "a"):
        spark.range(3).write.option("header", True).csv(f"{tmp_path}/in/{name}.csv")
    (tmp_path / "in" / "other.txt").write_text("x")
    assert sorted(csv_files(spark, f"{tmp_path}/in")) == ["a", "b"]
    spark.range(5).write.parquet(f"{tmp_path}/raw/raw_numbers")
    text = "SELECT COUNT(*) AS n FROM raw_numbers"
    assert transform_sql(spark, text, f"{tmp_path}/raw").first().n == 5
    assert not spark.catalog.tableExists("raw_numbers")


def test_descriptions_are_whole(spark):
    long = "word " * 40
    entities = [{"table": "t", "entity": "e", "description": long}]
    assert inventory.table_inventory(spark, {"t": spark.range(2)}, entities).first()[3] == long


def test_defaults_can_be_set():
    own = [{"row_count": {"min": 7}}]
    assert [r.min for r in rules_of({"metric": "m", "table": "t"}, own)] == [7]
    assert len(rules_of({"metric": "m", "table": "t"})) == 3


def test_percentile_over_a_full_range(spark):
    values = [(i * 2**45 - 2**62 + i,) for i in range(100_000)]
    df = spark.createDataFrame(values, "v long").repartition(4)
    for fraction, at in ((0.0, 0), (0.25, 24_999.75), (1.0, 99_999)):
        got = exact_percentile(df, F.col("v"), fraction, "p").first().p
        low = int(at)
        part = at - low
        want = values[low][0] + (values[min(low + 1, 99_999)][0] - values[low][0]) * part
        assert float(got) == pytest.approx(want, rel=1e-12)


def test_salted_join_splits_only_heavy_keys(spark):
    large = spark.createDataFrame([(i % 10 if i < 50 else 0, i) for i in range(300)], "k int, x int")
    small = spark.createDataFrame([(k, f"s{k}") for k in (0, 1, 2, 50)], "k int, s string")
    got = salted_join(large, small, ["k"], F.col("x"), rows_per_salt=20)
    assert Counter(map(tuple, got.collect())) == Counter(
        map(tuple, large.join(small, "k").collect())
    )


def test_previous_value_over_levels_of_chunks(spark):
    rows = [(i % 2, i, i * i % 7) for i in range(0, 400, 3)]
    df = spark.createDataFrame(rows, "k int, at int, v int").repartition(4)
    chunks = [F.floor(F.col("at") / w) for w in (4, 32, 128)]
    got = with_previous(df, ["k"], "at", F.col("v"), chunks, "before").collect()
    before = {}
    want = set()
    for k, at, v in rows:
        want.add((k, at, v, before.get(k)))
        before[k] = v
    assert {tuple(r) for r in got} == want


def test_subgraph_is_replaced(spark):
    schema = f"upstream string, downstream string, edge_type string, discovered_at {TIME}, last_seen_at {TIME}"
    old, new = datetime(2024, 1, 1), datetime(2024, 1, 2)
    stored = spark.createDataFrame(
        [("a", "m", "x", old, old), ("b", "m", "x", old, old), ("b", "n", "x", old, old)], schema
    )
    seen = spark.createDataFrame([("a", "m", "x", new, new), ("c", "m", "x", new, new)], schema)
    got = {tuple(r) for r in lineage.replace_subgraph(stored, "m", seen).collect()}
    assert got == {
        ("a", "m", "x", old, new),
        ("c", "m", "x", new, new),
        ("b", "n", "x", old, old),
    }
