"""Appends that may be run again, and damaged lines that go to a quarantine."""

from datetime import datetime

import pytest

from martwright.sources import once
from martwright.sources.load import SchemaMismatch, existing
from martwright.sources.once import FileChanged, append_once, loaded_rows
from martwright.sources.rejects import TooManyRejects, load_with_rejects, rejected_lines

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
COLUMNS = [{"name": "id", "type": "INTEGER"}, {"name": "name", "type": "VARCHAR"}, {"name": "amount", "type": "DOUBLE"}]
HEAD = "id,name,amount\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEAD + "1,a,1.5\n2,b,2.5\n")
    (tmp_path / "in" / "b [1].csv").write_text(HEAD + "3,c,3.5\n")
    (tmp_path / "in" / "notes.txt").write_text("no table")
    return tmp_path


def spec(folder, columns=COLUMNS, mode="append"):
    return {
        "source": {"type": "csv", "path": str(folder / "in"), "glob": "*.csv"},
        "target": {"table": "t", "mode": mode, "primary_key": "id"},
        "columns": columns,
    }


def ids(spark, folder):
    return sorted(r["id"] for r in loaded_rows(spark, f"{folder}/t").collect())


def test_a_second_run_adds_nothing_and_a_new_file_is_added(spark, folder):
    first = append_once(spark, spec(folder), str(folder), T1)
    assert (first.rows_added, first.rows_in_table) == (3, 3)
    again = append_once(spark, spec(folder), str(folder), T2)
    assert (again.rows_added, again.rows_in_table) == (0, 3)
    (folder / "in" / "c.csv").write_text(HEAD + "4,d,\n")
    more = append_once(spark, spec(folder), str(folder), T2)
    assert (more.rows_added, more.rows_in_table) == (1, 4)
    rows = loaded_rows(spark, f"{folder}/t").collect()
    assert {r["id"]: r["_loaded_at"] for r in rows} == {1: T1, 2: T1, 3: T1, 4: T2}


def test_a_changed_file_raises_and_a_missing_one_stays(spark, folder):
    append_once(spark, spec(folder), str(folder), T1)
    (folder / "in" / "b [1].csv").unlink()
    assert append_once(spark, spec(folder), str(folder), T2).rows_in_table == 3
    (folder / "in" / "a.csv").write_text(HEAD + "1,a,1.5\n2,b,2.5\n9,z,9\n")
    (folder / "in" / "d.csv").write_text(HEAD + "5,e,5\n")
    with pytest.raises(FileChanged, match="a.csv"):
        append_once(spark, spec(folder), str(folder), T2)
    assert ids(spark, folder) == [1, 2, 3]


@pytest.mark.parametrize("after_write", [False, True])
def test_a_batch_that_failed_is_done_again_with_its_files(spark, folder, monkeypatch, after_write):
    write = once._write_batch

    def fails(rows, path, number):
        if after_write:
            write(rows, path, number)
        raise RuntimeError("lost")

    monkeypatch.setattr(once, "_write_batch", fails)
    with pytest.raises(RuntimeError):
        append_once(spark, spec(folder), str(folder), T1)
    monkeypatch.setattr(once, "_write_batch", write)
    (folder / "in" / "c.csv").write_text(HEAD + "4,d,4\n")
    done = append_once(spark, spec(folder), str(folder), T2)
    assert (done.rows_added, done.rows_in_table) == (4, 4)
    assert ids(spark, folder) == [1, 2, 3, 4]
    assert append_once(spark, spec(folder), str(folder), T2).rows_added == 0


def test_files_without_rows_and_other_columns(spark, folder):
    (folder / "in" / "empty.csv").write_text(HEAD)
    assert append_once(spark, spec(folder), str(folder), T1).rows_added == 3
    (folder / "in" / "c.csv").write_text(HEAD + "4,d,4\n")
    with pytest.raises(SchemaMismatch):
        append_once(spark, spec(folder, [*COLUMNS[:2], {"name": "amount", "type": "VARCHAR"}]), str(folder), T2)
    # The batch was written down; the run with the right columns ends it.
    assert append_once(spark, spec(folder), str(folder), T2).rows_added == 1


def test_damaged_lines_and_rows_add_up_to_the_lines(spark, folder):
    (folder / "in" / "c.csv").write_text(
        HEAD + 'x7,d,4\n5,"e, ""five""",5\n6\n7,f,7,more\n8,,\n9,g,much\nq,h,none\n\n10,i,10\n'
    )
    result = load_with_rejects(spark, spec(folder), str(folder), T1, max_rate=0.6)
    assert (result.rows, result.rejected, result.loaded.rows_added) == (11, 5, 6)
    rows = spark.read.parquet(f"{folder}/t").orderBy("id").collect()
    assert [(r["id"], r["name"], r["amount"]) for r in rows] == [
        (1, "a", 1.5), (2, "b", 2.5), (3, "c", 3.5), (5, 'e, "five"', 5.0), (8, None, None), (10, "i", 10.0),
    ]
    bad = {r["line"]: r["reason"] for r in rejected_lines(spark, f"{folder}/t").collect()}
    assert bad == {
        "x7,d,4": "id: 'x7' is not int",
        "6": "number of fields",
        "7,f,7,more": "number of fields",
        "9,g,much": "amount: 'much' is not double",
        "q,h,none": "id: 'q' is not int; amount: 'none' is not double",
    }
    assert {r["file"].rsplit("/", 1)[1] for r in rejected_lines(spark, f"{folder}/t").collect()} == {"c.csv"}


def test_too_many_rejects_leave_the_table_and_keep_the_lines(spark, folder):
    load_with_rejects(spark, spec(folder), str(folder), T1)
    assert existing(spark, f"{folder}/t__rejects") is None
    (folder / "in" / "c.csv").write_text(HEAD + "x,d,4\n")
    for _ in range(2):
        with pytest.raises(TooManyRejects, match="1 of 4"):
            load_with_rejects(spark, spec(folder, mode="replace"), str(folder), T2, max_rate=0.2)
    assert spark.read.parquet(f"{folder}/t").count() == 3
    assert rejected_lines(spark, f"{folder}/t").count() == 1


def test_rejects_of_a_source_without_rows(spark, folder):
    for name in ("a.csv", "b [1].csv"):
        (folder / "in" / name).write_text(HEAD)
    result = load_with_rejects(spark, spec(folder), str(folder), T1, max_rate=0.0)
    assert (result.rows, result.rejected, result.loaded.rows_in_table) == (0, 0, 0)
    with pytest.raises(ValueError, match="declared columns"):
        load_with_rejects(spark, spec(folder, columns=None), str(folder), T1)
