import os
import threading

import pytest
from pyspark.sql import functions as F

from martwright.session import cut_lineage, scratch_dir, temporary_tables


def folder(frame):
    return os.path.dirname(frame.inputFiles()[0].removeprefix("file:")).replace("///", "/")


@pytest.fixture
def rows(spark):
    return spark.range(10).withColumn("half", F.col("id") / 2)


def test_tables_go_with_their_scope(spark, rows):
    with temporary_tables(spark):
        cut = cut_lineage(rows)
        assert cut.agg(F.sum("half")).first()[0] == 22.5
        assert os.path.isdir(folder(cut))
        path = folder(cut)
    assert not os.path.exists(path)


def test_tables_outside_a_scope_stay(spark, rows):
    before = cut_lineage(rows)
    with temporary_tables(spark):
        cut_lineage(rows)
    after = cut_lineage(rows)
    assert before.count() == after.count() == 10


def test_inner_scopes_leave_the_tables_of_outer_ones(spark, rows):
    with temporary_tables(spark):
        outer = cut_lineage(rows)
        with temporary_tables(spark):
            inner = folder(cut_lineage(outer.where("id > 5")))
        assert not os.path.exists(inner)
        later = cut_lineage(outer.where("id < 3"))
        assert (outer.count(), later.count()) == (10, 3)
        paths = folder(outer), folder(later)
    assert not any(map(os.path.exists, paths))


def test_tables_go_after_an_error(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr("martwright.session.scratch_dir", lambda *_: str(tmp_path / "cut"))
    with pytest.raises(Exception, match="no such row"), temporary_tables(spark):
        cut_lineage(rows.withColumn("x", F.when(F.col("id") > 8, F.raise_error(F.lit("no such row")))))
    assert os.listdir(tmp_path) == []


def test_other_threads_and_folders_are_left_alone(spark, rows):
    made = []
    with temporary_tables(spark):
        kept = scratch_dir(spark, "table")
        rows.write.parquet(kept)
        other = threading.Thread(target=lambda: made.append(cut_lineage(rows)))
        other.start()
        other.join()
    assert spark.read.parquet(kept).count() == made[0].count() == 10
