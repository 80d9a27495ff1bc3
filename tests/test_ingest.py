"""CSV scans, load modes, schema guard, inventory and running everything."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from martwright.operators import marts
from martwright.sources import inventory
from martwright.sources.files import declared_schema, scan_csv, scan_source, stamp_loaded
from martwright.sources.load import (
    SchemaMismatch,
    existing,
    last_days,
    load,
    load_folder,
    materialise,
    run_everything,
    run_ingest,
)

T1 = datetime(2024, 1, 1)
T2 = datetime(2024, 1, 2)
COLUMNS = [
    {"name": "order_id", "type": "INTEGER"},
    {"name": "customer_id", "type": "VARCHAR"},
    {"name": "status", "type": "VARCHAR"},
    {"name": "amount", "type": "DOUBLE"},
    {"name": "order_at", "type": "TIMESTAMP"},
]
ORDERS = '''order_id,customer_id,status,amount,order_at
1,a,paid,10.50,2024-01-01 09:00:00
2,b,"paid, ""late""",20.25,2023-12-01 10:00:00
'''


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "orders.csv").write_text(ORDERS)
    (tmp_path / "in" / "more.csv").write_text(ORDERS.replace("1,a", "3,c").replace("2,b", "4,d"))
    (tmp_path / "in" / "notes.txt").write_text("not a table")
    return tmp_path


def spec(folder, mode, path="in/orders.csv", columns=COLUMNS, **source):
    return {
        "source": {"type": "csv", "path": str(folder / path), **source},
        "target": {"table": "raw_orders", "mode": mode, "primary_key": "order_id"},
        "columns": columns,
    }


def test_declared_and_inferred_schema_agree(spark, folder):
    declared = scan_source(spark, spec(folder, "replace"))
    inferred = scan_csv(spark, str(folder / "in" / "orders.csv"))
    assert declared.schema.simpleString() == inferred.schema.simpleString()
    assert [r["status"] for r in declared.orderBy("order_id").collect()] == ["paid", 'paid, "late"']
    assert declared_schema([{"name": "x", "type": "DECIMAL(12,2)"}])["x"].dataType.simpleString() == "decimal(12,2)"
    with pytest.raises(ValueError):
        declared_schema([{"name": "x", "type": "BLOBBY"}])


def test_folder_and_glob(spark, folder):
    rows = scan_source(spark, spec(folder, "replace", "in", glob="*.csv"))
    assert sorted(r["order_id"] for r in rows.collect()) == [1, 2, 3, 4]


def test_only_csv(spark, folder):
    wanted = spec(folder, "replace")
    wanted["source"]["type"] = "rest"
    with pytest.raises(NotImplementedError):
        run_ingest(spark, wanted, str(folder), T1)


def test_replace_and_append(spark, folder):
    root = str(folder)
    first = run_ingest(spark, spec(folder, "replace"), root, T1)
    assert (first.rows_added, first.rows_in_table) == (2, 2)
    again = run_ingest(spark, spec(folder, "replace"), root, T2)
    assert again.rows_in_table == 2
    stored = spark.read.parquet(f"{root}/raw_orders")
    assert {r["_loaded_at"] for r in stored.collect()} == {T2}
    more = run_ingest(spark, spec(folder, "append"), root, T2)
    assert (more.rows_added, more.rows_in_table) == (2, 4)
    assert more.mode == "append"


def test_append_matches_columns_by_name(spark, folder):
    path = str(folder / "t")
    rows = stamp_loaded(spark.sql("SELECT 1 AS a, 'x' AS b"), T1)
    load(rows, path, "append")
    load(rows.select("_loaded_at", "b", "a"), path, "append")
    assert {(r["a"], r["b"]) for r in spark.read.parquet(path).collect()} == {(1, "x")}


def test_schema_guard(spark, folder):
    path = str(folder / "t")
    load(stamp_loaded(spark.sql("SELECT 1 AS a, 'x' AS b"), T1), path)
    with pytest.raises(SchemaMismatch, match="missing b; new c; a is string, stored as int"):
        load(stamp_loaded(spark.sql("SELECT '1' AS a, 'x' AS c"), T1), path)
    assert spark.read.parquet(path).count() == 1


def test_unknown_mode_raises(spark, folder):
    with pytest.raises(ValueError, match="unknown load mode"):
        load(stamp_loaded(spark.range(1), T1), str(folder / "t"), "upsert")
    with pytest.raises(ValueError, match="primary_key"):
        load(stamp_loaded(spark.range(1), T1), str(folder / "t"), "merge")
    assert existing(spark, str(folder / "t")) is None


def test_merge_keeps_the_latest_row_per_key(spark, folder):
    path = str(folder / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, n int")
    load(stamp_loaded(rows((1, "old", 1), (2, "kept", 1), (2, "lost", 0)), T1), path, "merge", ["k"], ["n"])
    result = load(stamp_loaded(rows((1, "new", 0), (3, "first", 1), (3, "second", 2)), T2), path, "merge", ["k"], ["n"])
    assert (result.rows_added, result.rows_in_table) == (3, 3)
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {
        (1, "new"),
        (2, "kept"),
        (3, "second"),
    }


def test_merge_rewrites_only_the_partitions_of_the_batch(spark, folder):
    path = str(folder / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "day int, k int, v string")
    load(stamp_loaded(rows((1, 1, "a"), (1, 2, "b"), (2, 1, "c")), T1), path, "merge", ["day", "k"], None, ["day"])
    files = lambda day: {p.name for p in (folder / "t" / f"day={day}").glob("*.parquet")}
    untouched = files(2)
    load(stamp_loaded(rows((1, 1, "z"), (3, 1, "n")), T2), path, "merge", ["day", "k"], None, ["day"])
    assert files(2) == untouched
    assert {(r["day"], r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {
        (1, 1, "z"), (1, 2, "b"), (2, 1, "c"), (3, 1, "n"),
    }


def test_merge_treats_null_as_a_key(spark, folder):
    for name, parts in (("plain", None), ("parted", ["day"])):
        path = str(folder / name)
        rows = lambda *r: spark.createDataFrame(list(r), "day int, k int, v string")
        first = rows((None, 1, "a"), (None, 2, "b"), (1, None, "c"))
        load(stamp_loaded(first, T1), path, "merge", ["day", "k"], None, parts)
        second = rows((None, 1, "z"), (1, None, "y"))
        load(stamp_loaded(second, T2), path, "merge", ["day", "k"], None, parts)
        stored = {(r["day"], r["k"], r["v"]) for r in spark.read.parquet(path).collect()}
        assert stored == {(None, 1, "z"), (None, 2, "b"), (1, None, "y")}


def test_merge_under_a_hot_key(spark, folder):
    path = str(folder / "t")
    hot = spark.range(20000).select(
        F.when(F.col("id") < 15000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("n")
    )
    result = load(stamp_loaded(hot, T1), path, "merge", ["k"], ["n"])
    assert result.rows_in_table == 5001
    assert spark.read.parquet(path).filter("k = 0").first()["n"] == 14999


def test_last_days_and_backfill(spark, folder):
    wanted = spec(folder, "replace", since_column="order_at")
    assert run_ingest(spark, wanted, str(folder), datetime(2024, 1, 2)).rows_in_table == 1
    assert run_ingest(spark, wanted, str(folder), datetime(2024, 1, 2), backfill=True).rows_in_table == 2
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2023-12-26 00:00:00' AS at")
    assert last_days(rows, "at", datetime(2024, 1, 2)).count() == 1


def test_folder_of_tables_and_run_everything(spark, folder):
    root = str(folder / "wh")
    load_folder(spark, {"orders": str(folder / "in" / "orders.csv")}, root, T1)
    assert spark.read.parquet(f"{root}/orders").count() == 2

    def mart_daily_revenue(read, as_of):
        return marts.daily_revenue(read("raw_orders"), as_of)

    counts = run_everything(
        spark, {"orders": spec(folder, "replace")}, {"mart_daily_revenue": mart_daily_revenue}, root, T1
    )
    assert counts == {"raw_orders": 2, "mart_daily_revenue": 1}
    before = spark.read.parquet(f"{root}/mart_daily_revenue").collect()
    mart = marts.daily_revenue(spark.read.parquet(f"{root}/raw_orders"), T1)
    assert materialise(mart, f"{root}/mart_daily_revenue") == 1
    assert spark.read.parquet(f"{root}/mart_daily_revenue").collect() == before


def test_inventory_and_health(spark):
    tables = {"a": spark.range(3), "b": None}
    entities = [{"table": "a", "entity": "thing", "description": "d" * 80}]
    rows = {r["table_name"]: r for r in inventory.table_inventory(spark, tables, entities).collect()}
    assert (rows["a"]["row_count"], rows["a"]["entity"], rows["a"]["description"]) == ("3", "thing", "d" * 80)
    assert (rows["b"]["row_count"], rows["b"]["entity"]) == ("?", "—")
    health = inventory.ingest_health(spark, {"x": {"target": {"table": "a"}}, "y": {}}, {"a": tables["a"]})
    assert {(r["table_name"], r["row_count"], r["state"]) for r in health.collect()} == {
        ("a", 3, "loaded"),
        ("raw_y", None, "missing"),
    }
