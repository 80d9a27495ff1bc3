"""Stream-stream join and distinct append, cut into batches in different ways."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from martwright.plans import REGISTRY, views
from martwright.session import scratch_dir
from martwright.streaming.streams import set_clock, stream_abandoned_carts, stream_distinct_append

ROOT = "/root/testdata/sf0.001"
AS_OF = views.EVENTS_AS_OF
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def deliver(spark, rows, folder):
    """One more file of the source."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, schema, **more):
    run = stream_abandoned_carts(
        spark, f"{folder}/in", f"{folder}/clock", schema, f"{folder}/out", f"{folder}/checkpoint",
        key=["user_id", "CASE WHEN user_id IS NOT NULL THEN CAST(ts AS DATE) END"],
        cart="event_type = 'click'", checkout="event_type = 'purchase'", **more,
    )
    return run, sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))


@pytest.mark.parametrize("files", [1, 4])
def test_any_cut_gives_the_carts_of_the_batch_form(spark, files):
    events = views.events(spark, ROOT).select("event_id", "ts", "user_id", "event_type").orderBy("ts").collect()
    folder = scratch_dir(spark, "test_carts")
    draw = random.Random(files)
    cuts = sorted(draw.sample(range(1, len(events)), files - 1))
    for a, b in zip([0, *cuts], [*cuts, len(events)], strict=True):
        part = [tuple(r) for r in events[a:b]]
        draw.shuffle(part)
        deliver(spark, part, f"{folder}/in")
    schema = spark.createDataFrame([], SCHEMA).schema
    set_clock(spark, f"{folder}/clock", schema, "ts", AS_OF - timedelta(days=400))
    first, early = run(spark, folder, schema, max_files=1)
    set_clock(spark, f"{folder}/clock", schema, "ts", AS_OF + timedelta(days=7))
    second, found = run(spark, folder, schema)
    want = {tuple(r) for r in REGISTRY["abandoned_carts"].build(spark, ROOT).collect() if r["user_id"] is not None}
    assert found == sorted(want)
    assert set(early) < set(found)  # the last windows are open until the clock says more
    assert first.rows_too_late == second.rows_too_late == 0


def test_carts_wait_for_their_window_and_late_rows_are_counted(spark):
    folder = scratch_dir(spark, "test_late")
    schema = spark.createDataFrame([], SCHEMA).schema
    at = lambda day, hour=0: datetime(2024, 1, day, hour)
    set_clock(spark, f"{folder}/clock", schema, "ts", at(1))
    deliver(spark, [(1, at(2, 9), 7, "click"), (2, at(2, 10), 8, "click"), (3, at(2, 11), 7, "click"),
                    (4, at(2, 12), None, "click")], f"{folder}/in")
    assert run(spark, folder, schema)[1] == []
    # a checkout before or after the cart counts, in a later run too
    deliver(spark, [(5, at(2, 1), 8, "purchase"), (6, at(3, 1), 7, "purchase")], f"{folder}/in")
    set_clock(spark, f"{folder}/clock", schema, "ts", at(9))
    assert run(spark, folder, schema)[1] == [(7, at(2).date())]
    deliver(spark, [(7, at(2, 9), 9, "click"), (8, at(2, 9), 9, "purchase"), (9, at(9, 1), 5, "click")], f"{folder}/in")
    late, found = run(spark, folder, schema)
    assert late.rows_too_late == 2
    assert found == [(7, at(2).date())]


def test_events_delivered_again_count_once(spark):
    folder = scratch_dir(spark, "test_distinct")
    schema = spark.createDataFrame([], SCHEMA).schema
    at = lambda day: datetime(2024, 1, day)

    def append(**more):
        run = stream_distinct_append(spark, f"{folder}/in", schema, f"{folder}/out", f"{folder}/checkpoint",
                                     key=["event_id"], keep="2 days", **more)
        return run, sorted((r["event_id"] or 0) for r in spark.read.parquet(f"{folder}/out").collect())

    deliver(spark, [(1, at(1), 7, "a"), (1, at(1), 7, "a"), (2, at(2), 7, "a"), (None, at(2), 1, "a"),
                    (None, at(2), 1, "a")], f"{folder}/in")
    deliver(spark, [(2, at(2), 7, "a"), (3, at(3), 7, "a")], f"{folder}/in")
    assert append(max_files=1)[1] == [0, 0, 1, 2, 3]
    deliver(spark, [(3, at(3), 7, "a"), (4, at(9), 7, "a")], f"{folder}/in")
    assert append()[1] == [0, 0, 1, 2, 3, 4]
    deliver(spark, [(1, at(1), 7, "a")], f"{folder}/in")
    again, ids = append()
    assert ids == [0, 0, 1, 2, 3, 4] and again.rows_too_late == 1
