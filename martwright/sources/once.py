"""Appends that may be run again: every file of a source is loaded once.

A ledger beside the table (``<table>__files``) keeps path, size and time of each file. A run lists the
source without opening a file, leaves the files that the ledger has, and writes the others down as the
next batch before it reads them. The rows of a batch are one folder of the table and a batch that
did not come to its end is done again, with the same files, into the same folder. So neither a
second run nor a retry after a failure at any place adds a row twice. One writer per table.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martwright.sources.files import declared_schema, scan_csv, stamp_loaded
from martwright.sources.load import (
    FILES,
    LoadResult,
    SchemaMismatch,
    _file_system,
    existing,
    guard_schema,
)

BATCH = "_batch"


class FileChanged(ValueError):
    """A file that was loaded has another size or time now."""


def source_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, modified) of every file of a source; the contents are not read."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def append_once(spark: SparkSession, spec: dict, root: str, as_of: datetime) -> LoadResult:
    """Append the files of the spec's source that were not loaded yet.

    A loaded file that changed since raises ``FileChanged`` and nothing is loaded. One that is gone
    from the source stays loaded. ``_loaded_at`` is the time of the run that ended the batch.
    """
    source = spec["source"]
    if source["type"] != "csv":
        raise NotImplementedError(f"source type '{source['type']}' is not supported, only csv")
    path = f"{root}/{spec['target']['table']}"
    ledger = path + FILES
    known = existing(spark, f"{ledger}/planned")
    found = source_files(spark, source["path"], source.get("glob"))
    batches, last = [], 0
    if known is not None:
        _refuse_changed(found, known, path)
        last = known.agg(F.max(BATCH)).first()[0]
        if not _is_done(spark, ledger, last):
            batches.append(last)
        found = found.join(known, "path", "left_anti")
    planned = f"{ledger}/planned/{BATCH}={last + 1}"
    if not found.isEmpty():
        found.write.mode("overwrite").parquet(planned)
        batches.append(last + 1)

    added = 0
    for number in batches:
        files = spark.read.parquet(f"{ledger}/planned/{BATCH}={number}").select("path").collect()
        rows = scan_csv(
            spark,
            [_literal(f["path"]) for f in files],
            declared_schema(spec.get("columns")),
            multiline=bool(source.get("multiline", False)),
        )
        added += _write_batch(stamp_loaded(rows, as_of), path, number)
        fs, at = _file_system(spark, ledger)
        fs.create(at(f"{ledger}/done/{number}")).close()
    table = existing(spark, path)
    return LoadResult(path, "append", added, 0 if table is None else table.count())


def loaded_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` without the column that names its batches."""
    return spark.read.parquet(path).drop(BATCH)


def _write_batch(rows: DataFrame, path: str, number: int) -> int:
    """Write the folder of a batch, in place of what a failed run may have left there."""
    spark = rows.sparkSession
    stored = existing(spark, path)
    if stored is not None:
        if BATCH not in stored.columns:
            raise SchemaMismatch(f"{path}: stored without batches")
        guard_schema(stored.drop(BATCH), rows, path)
        rows = rows.select(*stored.drop(BATCH).columns)
    folder = f"{path}/{BATCH}={number}"
    rows.write.mode("overwrite").parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder).count()


def _is_done(spark: SparkSession, ledger: str, number: int) -> bool:
    fs, at = _file_system(spark, ledger)
    return fs.exists(at(f"{ledger}/done/{number}"))


def _refuse_changed(found: DataFrame, known: DataFrame, table: str) -> None:
    before = known.select("path", F.col("length").alias("_length"), F.col("modified").alias("_modified"))
    differs = (F.col("length") != F.col("_length")) | (F.col("modified") != F.col("_modified"))
    changed = found.join(before, "path").filter(differs).orderBy("path").limit(5).collect()
    if changed:
        raise FileChanged(f"{table}: loaded files have changed: {', '.join(c['path'] for c in changed)}")


def _literal(path: str) -> str:
    """A path whose signs of a file pattern stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
