"""Runs, streaks, revisions, catalog, reconciliation, measures, lineage and streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from martwright.operators import history, lineage, reconcile, semantic
from martwright.plans.lineage import edge_tasks, edges
from martwright.streaming.streams import run_row, stream_append, stream_daily_checks

DAY = datetime(2024, 1, 1)


def results(spark, words, metric="m", rule="r", every=timedelta(days=20)):
    names = {"P": "passed", "F": "failed", "W": "warning", "E": "error"}
    rows = [(metric, rule, DAY + i * every, names[w], f"run {i}") for i, w in enumerate(words)]
    return spark.createDataFrame(
        rows, "metric string, rule string, started_at timestamp_ntz, status string, message string"
    )


def test_one_issue_for_three_failures_in_a_row(spark):
    rows = results(spark, "FFFPFF")
    (issue,) = history.failing_streaks(rows).collect()
    assert (issue["runs"], issue["streak_start"]) == (3, DAY)
    assert issue["title"] == "[trust] m failed: r"
    assert len(issue["dedup_key"]) == 12
    assert history.recovered_streaks(rows).count() == 0
    recovered = history.recovered_streaks(results(spark, "FFFPFFPPP")).first()
    assert recovered["recovered_from"] == DAY + 6 * timedelta(days=20)


def test_warnings_break_a_streak_and_errors_are_not_failures(spark):
    assert history.failing_streaks(results(spark, "FFWFFEF")).count() == 0


def test_a_new_failing_streak_reopens(spark):
    assert history.recovered_streaks(results(spark, "FFFPPPFFF")).count() == 0


def test_issue_draft_shows_the_newest_runs(spark):
    draft = history.issue_drafts(results(spark, "FFFFPPW")).first()
    lines = draft["recent_history"].split("\n")
    assert len(lines) == history.SHOWN_RUNS
    assert lines[-1] == "- 2024-04-30 00:00:00: warning (run 6)"
    assert (draft["streaks"], draft["longest"]) == (1, 4)


def runs(spark):
    rows = [
        (m, DAY + timedelta(days=i), s, float(i), i * 10)
        for m, words in {"a": ["passed"] * 9, "b": ["passed", "failed"], "c": ["warning"] * 8}.items()
        for i, s in enumerate(words)
    ]
    return spark.createDataFrame(
        rows, "metric_name string, started_at timestamp_ntz, status string, value_sum double, row_count int"
    )


def test_latest_and_traffic_light(spark):
    now = DAY + timedelta(days=9)
    light = {r["metric_name"]: (r["short_status"], r["light"]) for r in history.latest_status(runs(spark), now).collect()}
    assert light == {"a": ("pass", "green"), "b": ("fail", "grey"), "c": ("warn", "yellow")}
    red = history.latest_status(runs(spark), DAY + timedelta(days=2)).filter("metric_name = 'b'").first()
    assert red["light"] == "red"


def test_last_runs_ascend(spark):
    last = history.last_runs(runs(spark), 3).filter("metric_name = 'a'").orderBy("position").collect()
    assert [r["value_sum"] for r in last] == [6.0, 7.0, 8.0]


def test_baseline_is_a_period_back(spark):
    base = history.previous_period_run(runs(spark), DAY + timedelta(days=9), 7)
    assert {r["metric_name"]: r["value_sum"] for r in base.collect()} == {"a": 2.0, "b": 1.0, "c": 2.0}
    assert history.baseline(runs(spark)).columns == ["metric_name", "recorded_at", "value_sum", "row_count"]


def test_append_history_is_partitioned_by_month(spark, tmp_path):
    path = str(tmp_path / "runs")
    history.append_history(runs(spark), path)
    history.append_history(runs(spark), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2 * runs(spark).count()
    assert {r["month"] for r in stored.select("month").distinct().collect()} == {"2024-01"}


def test_snapshot(spark):
    frame = spark.createDataFrame([(1, 2.5), (2, None)], "id int, amount double")
    row = history.run_snapshot(frame, "m", "amount", ["id", "amount"], DAY).first()
    assert (row["row_count"], row["value_sum"]) == (2, 2.5)
    assert row["column_means_json"] == '{"id":"1.5000","amount":"2.5000"}'
    other = history.run_snapshot(frame.withColumn("x", F.lit(1)), "m", "amount", ["id"], DAY).first()
    assert other["schema_fingerprint"] != row["schema_fingerprint"]


@pytest.mark.parametrize("width", [1, 2, 100])
def test_revisions(spark, width):
    texts = ["a", "a", "b", "a", "a", None, None, "a"]
    frame = spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "m string, n int, t string")
    chunk = F.floor(F.col("n") / width)
    kept = history.kept_revisions(frame, ["m"], "n", "t", chunk).orderBy("n")
    assert [r["n"] for r in kept.collect()] == [0, 2, 3, 5, 7]
    newest = history.latest_revisions(frame, ["m"], "n", "t", chunk, 2).orderBy("position")
    assert [r["n"] for r in newest.collect()] == [7, 5]


def test_freshness_header_skips_empty_tables(spark):
    t = lambda s: spark.sql(f"SELECT TIMESTAMP_NTZ'{s}' AS at")
    row = history.freshness_header(
        {"a": (t("2024-01-02"), "at"), "b": (t("2024-01-01"), "at"), "c": (t("2023-01-01").limit(0), "at")}
    ).first()
    assert (row["data_through"], row["oldest_table"], row["tables"]) == (DAY, "b", 2)


def test_catalog_pages(spark):
    frame = spark.createDataFrame(
        [(f"m{i:02d}", "Revenue %" if i % 2 else "signups", "fin") for i in range(30)],
        "metric string, description string, owner string",
    )
    page = history.catalog_search(frame, ["metric", "description"], "REVENUE %", {"owner": "fin"}, after="m19", page_size=10)
    assert [r["metric"] for r in page.collect()] == ["m21", "m23", "m25", "m27", "m29"]


# -- reconciliation ------------------------------------------------------------


def test_reconcile(spark):
    metrics = spark.createDataFrame([("mrr",), ("zero",), ("none",)], "metric string")
    warehouse = spark.createDataFrame([("mrr", 482150.0), ("zero", 0.0)], "metric string, value double")
    external = spark.createDataFrame(
        [
            ("mrr", "near", 481820.0, None),
            ("mrr", "far", 479900.0, None),
            ("mrr", "warn", 482150.0 * 1.05, None),
            ("mrr", "off", 482150.0 * 0.9, None),
            ("mrr", "down", None, "timeout"),
            ("zero", "any", 5.0, None),
        ],
        "metric string, source string, value double, error string",
    )
    rows = reconcile.reconcile(metrics, warehouse, external).collect()
    got = {(r["metric"], r["source"]): (r["status"], r["delta"]) for r in rows}
    assert got[("mrr", "near")][0] == "pass" and round(100 * got[("mrr", "near")][1], 2) == -0.07
    assert got[("mrr", "far")][0] == "pass" and round(100 * got[("mrr", "far")][1], 2) == -0.47
    assert got[("mrr", "warn")][0] == "warn"
    assert got[("mrr", "off")][0] == "fail"
    assert got[("mrr", "down")] == ("fail", None)
    assert got[("zero", "any")] == ("pass", 0.0)
    first = [r for r in rows if r["position"] == 0]
    assert {(r["metric"], r["source"], r["delta"], r["status"]) for r in first} == {
        (m, "warehouse", 0.0, "pass") for m in ("mrr", "zero", "none")
    }


def test_reconcile_by_dimension(spark):
    left = spark.createDataFrame([("x", 100.0), ("y", 50.0)], "d string, value double")
    right = spark.createDataFrame([("x", 101.0), ("z", 1.0)], "d string, value double")
    got = {r["d"]: (r["status"], r["delta"]) for r in reconcile.reconcile_by_dimension(left, right, ["d"]).collect()}
    assert got == {"x": ("pass", 0.01), "y": ("fail", None), "z": ("fail", None)}


# -- measures ------------------------------------------------------------------

ENTITIES = [
    {
        "entity": "sale", "kind": "fact", "table": "sales", "primary_key": "id", "dimensions": ["status"],
        "measures": [
            {"name": "revenue", "aggregation": "sum", "source": "amount", "filter": "status = 'paid'", "digits": 2},
            {"name": "sales", "aggregation": "count", "source": "*"},
            {"name": "mean", "aggregation": "avg", "source": "amount"},
            {"name": "smallest", "aggregation": "min", "source": "amount"},
            {"name": "people", "aggregation": "count_distinct", "source": "person"},
        ],
        "joins": [{"to": "shop", "column": "shop_id"}],
    },
    {"entity": "shop", "kind": "dimension", "table": "shops", "primary_key": "id", "dimensions": ["name"],
     "joins": [{"to": "land", "column": "land_id"}]},
    {"entity": "land", "kind": "dimension", "table": "lands", "primary_key": "id", "dimensions": ["name"]},
]


@pytest.fixture
def star(spark):
    return {
        "sales": spark.createDataFrame(
            [(1, "paid", 10.0, 1, "a"), (2, "paid", 20.5, 2, "a"), (3, "refunded", 7.0, 1, "b"), (4, "paid", 1.0, 9, "c")],
            "id int, status string, amount double, shop_id int, person string",
        ),
        "shops": spark.createDataFrame([(1, "s1", 1), (2, "s2", 1)], "id int, name string, land_id int"),
        "lands": spark.createDataFrame([(1, "L")], "id int, name string"),
    }


def test_measures_follow_declared_joins(star):
    rows = semantic.measure_by(ENTITIES, star, "sale", ["revenue", "sales", "mean", "smallest", "people"], ["land.name"])
    got = {r["land_name"]: tuple(r)[1:] for r in rows.collect()}
    assert got == {"L": (30.5, 3, 12.5, 7.0, 2), None: (1.0, 1, 1.0, 1.0, 1)}
    total = semantic.measure_by(ENTITIES, star, "sale", ["revenue"], []).collect()
    assert [tuple(r) for r in total] == [(31.5,)]
    both = semantic.measure_by(ENTITIES, star, "sale", ["revenue", "people"], []).collect()
    assert [tuple(r) for r in both] == [(31.5, 3)]
    own = semantic.measure_by(ENTITIES, star, "sale", ["sales"], ["sale.status", "shop.name"]).collect()
    assert ("refunded", "s1", 1) in {tuple(r) for r in own}


def test_undeclared_names_raise(star):
    with pytest.raises(ValueError, match="no measure"):
        semantic.measure_by(ENTITIES, star, "sale", ["profit"], ["land.name"])
    with pytest.raises(ValueError, match="not a declared dimension"):
        semantic.measure_by(ENTITIES, star, "sale", ["sales"], ["land.colour"])
    with pytest.raises(ValueError, match="no declared join"):
        semantic.measure_by(ENTITIES, star, "land", [], ["sale.status"])


def test_filters_are_checked(star):
    kept = semantic.checked_filter(star["sales"], [{"column": "amount", "op": ">", "value": 7}])
    assert kept.count() == 2
    with pytest.raises(ValueError, match="unknown column"):
        semantic.checked_filter(star["sales"], [{"column": "1=1 --", "op": "=", "value": 1}])
    with pytest.raises(ValueError, match="not allowed"):
        semantic.checked_filter(star["sales"], [{"column": "amount", "op": "like", "value": 1}])


def test_answer_falls_back_to_the_stored_value(spark):
    values = spark.createDataFrame([("a", 5.0), ("b", None), ("x", None)], "metric_name string, value double")
    rows = {r["metric_name"]: r for r in semantic.answer_with_trust(values, history.latest_run(runs(spark))).collect()}
    assert (rows["a"]["value"], rows["a"]["stale"], rows["a"]["trust_status"]) == (5.0, False, "passed")
    assert (rows["b"]["value"], rows["b"]["stale"], rows["b"]["trust_status"]) == (1.0, True, "failed")
    assert (rows["x"]["value"], rows["x"]["stale"], rows["x"]["trust_status"]) == (None, False, "unknown")


# -- lineage -------------------------------------------------------------------


def edge_rows(spark, *pairs):
    return spark.createDataFrame(
        [(a, b, "derives_from", DAY + timedelta(days=i), DAY + timedelta(days=i)) for i, (a, b) in enumerate(pairs)],
        "upstream string, downstream string, edge_type string, discovered_at timestamp_ntz, last_seen_at timestamp_ntz",
    )


def test_edges_keep_first_and_last_sight(spark):
    (edge,) = lineage.upsert_edges(edge_rows(spark, ("a", "b")), edge_rows(spark, ("a", "b"), ("a", "b"))).collect()
    assert (edge["discovered_at"], edge["last_seen_at"]) == (DAY, DAY + timedelta(days=1))


def test_upstream_is_bounded_and_takes_the_shortest_way(spark):
    edges = edge_rows(
        spark, ("t4", "t3"), ("t3", "t2"), ("t2", "t1"), ("t1", "m"), ("t2", "m"), ("m", "t3"), ("m", "m")
    )
    metrics = spark.createDataFrame([("m", "tab"), ("bare", "tab")], "metric string, primary_table string")
    walk = lineage.upstream(metrics, edges)
    assert {(r["node"], r["hops"]) for r in walk.collect()} == {("t1", 1), ("t2", 1), ("t3", 2), ("t4", 3)}
    whole = {(r["metric"], r["node"]) for r in lineage.with_stub(metrics, edges, walk).collect()}
    assert ("bare", "tab") in whole and ("m", "tab") not in whole


def test_dealt_edges_are_the_same_in_as_many_tasks(spark):
    seen = [edge_rows(spark, *((f"s{i % 7}", f"t{i % 5}") for i in range(60))), edge_rows(spark, ("t1", "m"), ("t2", "m"))]
    dealt = lineage.upsert_edges(*seen, tasks=11)
    assert dealt.rdd.getNumPartitions() == 11
    assert sorted(dealt.collect()) == sorted(lineage.upsert_edges(*seen).collect())
    metrics = spark.createDataFrame([("m", "tab"), ("bare", "tab")], "metric string, primary_table string")
    walk = lineage.upstream(metrics, dealt, tasks=13)
    assert sorted(walk.collect()) == sorted(lineage.upstream(metrics, dealt).collect())


def test_tables_beyond_what_the_tasks_hold_are_dealt_over_more(spark, tmp_path):
    root = str(tmp_path)
    stamp = F.lit(DAY).cast("timestamp_ntz")
    nulled = lambda c, n: F.when(F.col("id") % 9 > 0, F.col("id") % n).alias(c)
    rows = {
        "lineitem": spark.range(500).select(nulled("l_suppkey", 7), nulled("l_partkey", 40), stamp.alias("l_shipdate")),
        "part": spark.range(40).select(nulled("p_partkey", 40), F.concat(F.lit("b"), F.col("id") % 3).alias("p_brand"), F.lit("t").alias("p_type")),
        "supplier": spark.range(7).select(F.col("id").alias("s_suppkey"), (F.col("id") % 2).cast("int").alias("s_nationkey")),
        "nation": spark.range(2).selectExpr("cast(id as int) n_nationkey", "1 n_regionkey"),
    }
    for name, frame in rows.items():
        frame.write.parquet(f"{root}/{name}.parquet")
    assert edge_tasks(spark, root) is None
    tasks = edge_tasks(spark, root, rows_per_task=20)
    assert tasks == 28
    dealt, plain = edges(spark, root, tasks), edges(spark, root, None)
    assert dealt.rdd.getNumPartitions() == 28
    order = lambda r: tuple(map(str, r))
    assert sorted(dealt.collect(), key=order) == sorted(plain.collect(), key=order)


def test_node_kinds(spark):
    frame = spark.createDataFrame([("source",), ("model",), ("metric",), ("odd",), (None,)], "k string")
    kinds = [r[0] for r in frame.select(lineage.node_kind(F.col("k"))).collect()]
    assert kinds == ["source", "transform", "metric", "transform", "transform"]


# -- streams -------------------------------------------------------------------

SCHEMA = "event_id int, ts timestamp_ntz, value double"


def events(spark, *rows):
    return spark.createDataFrame([(i, datetime.fromisoformat(t), v) for i, t, v in rows], SCHEMA)


def test_second_append_run_adds_only_new_files(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frame = events(spark, (1, "2024-01-01 10:00:00", 1.0), (2, "2024-01-01 11:00:00", None))
    frame.write.parquet(source)
    run = lambda: stream_append(spark, source, frame.schema, target, state, DAY)
    assert run().rows_in == 2
    assert run().rows_in == 0
    events(spark, (3, "2024-01-02 10:00:00", 1.0)).write.mode("append").parquet(source)
    assert run().rows_in == 1
    stored = spark.read.parquet(target)
    assert sorted(r["event_id"] for r in stored.collect()) == [1, 2, 3]
    assert {r["_loaded_at"] for r in stored.collect()} == {DAY}


def test_daily_stream_updates_open_days_and_counts_late_rows(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    frame = events(spark, (1, "2024-01-01 10:00:00", 1.0), (2, "2024-01-03 22:00:00", None))
    frame.coalesce(1).write.parquet(source)
    run = lambda: stream_daily_checks(spark, source, frame.schema, target, state)
    assert run().rows_too_late == 0
    late = events(spark, (3, "2024-01-01 11:00:00", 1.0), (4, "2024-01-03 23:00:00", 2.0))
    late.coalesce(1).write.mode("append").parquet(source)
    outcome = run()
    assert outcome.rows_too_late == 1
    row = run_row(spark, "daily", outcome, DAY).first()
    assert (row["status"], row["row_count"], row["rows_too_late"]) == ("warning", 2, 1)
    got = {str(r["day"]): (r["row_count"], r["null_values"]) for r in spark.read.parquet(target).collect()}
    assert got == {"2024-01-01": (1, 0), "2024-01-03": (2, 1)}
