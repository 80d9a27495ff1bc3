"""Load modes for raw tables kept as parquet folders.

``replace`` rewrites, ``append`` adds rows by column name, ``merge`` keeps the
latest row per primary key. An unknown mode raises.

A table loaded with ``buckets`` is cut into that many folders by a hash of its primary key. A merge
then reads and rewrites the folders of the incoming keys only, whatever the key is, and can write down
the rows it takes out and puts in (``changes``), from which marts are kept up to date
(``operators/incremental.py``).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from martwright.functions.values import within
from martwright.session import cut_lineage
from martwright.session import file_system as _file_system
from martwright.sources.files import scan_source, stamp_loaded, target_table

MODES = ("append", "replace", "merge")
# Suffixes of a table that is being written and of the one it replaces, and of a table's ledger of files.
_NEXT, _ASIDE, FILES = "__next", "__aside", "__files"
# Folder column of a bucketed table, and the sign of a change.
BUCKET, SIGN = "_bucket", "_sign"


class SchemaMismatch(ValueError):
    """The target table exists with a different schema."""


@dataclass(frozen=True)
class LoadResult:
    table: str
    mode: str
    rows_added: int
    rows_in_table: int


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None when nothing is stored yet."""
    fs, at = _file_system(spark, path)
    if not fs.exists(at(path)) and fs.exists(at(path + _ASIDE)):
        fs.rename(at(path + _ASIDE), at(path))
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """A stored table without the column that names its folders."""
    return spark.read.parquet(path).drop(BUCKET)


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Number of the folder of a key; missing parts of a key count as values."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def folder_bytes(spark: SparkSession, path: str) -> dict[int, int]:
    """Bytes of every folder of a bucketed table, by its number."""
    fs, at = _file_system(spark, path)
    return {
        int(s.getPath().getName().split("=")[1]): fs.getContentSummary(s.getPath()).getLength()
        for s in fs.globStatus(at(f"{path}/{BUCKET}=*"))
    }


def guard_schema(stored: DataFrame, incoming: DataFrame, table: str) -> None:
    """Refuse a load whose columns or types differ from the stored table."""
    have = {f.name: f.dataType.simpleString() for f in stored.schema.fields}
    come = {f.name: f.dataType.simpleString() for f in incoming.schema.fields}
    if have == come:
        return
    parts = [f"missing {c}" for c in sorted(have.keys() - come.keys())]
    parts += [f"new {c}" for c in sorted(come.keys() - have.keys())]
    parts += [
        f"{c} is {come[c]}, stored as {have[c]}"
        for c in sorted(have.keys() & come.keys())
        if have[c] != come[c]
    ]
    raise SchemaMismatch(f"{table}: {'; '.join(parts)}")


def last_days(df: DataFrame, column: str, as_of: datetime, days: int = 7) -> DataFrame:
    """Incremental slice: rows of the last ``days`` days, no upper bound."""
    return df.filter(within(df, column, as_of - timedelta(days=days), None))


def latest_per_key(df: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """One row per key, first by ``newest`` descending.

    The rank filter is applied in each map task before the shuffle, so a key that holds
    a large part of the rows sends one row per task.
    """
    order = Window.partitionBy(*keys).orderBy(*[c.desc() for c in newest])
    return df.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def merged(
    stored: DataFrame, incoming: DataFrame, keys: list[str], newest: list[Column]
) -> DataFrame:
    """Upsert: stored rows whose key does not come, and per key that comes the newest row.

    A stored row stays if it is newer than the incoming one by ``newest``; of equally new ones the
    incoming one stays. A small batch is broadcast by its size, and then the stored rows are not
    shuffled.
    """
    contested = (
        _match(stored, incoming, keys, "left_semi")
        .withColumn("_comes", F.lit(0))
        .unionByName(incoming.withColumn("_comes", F.lit(1)))
    )
    kept = latest_per_key(contested, keys, [*newest, F.col("_comes")]).drop("_comes")
    return _match(stored, incoming, keys, "left_anti").unionByName(kept)


def settled(stored: DataFrame, batch: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """Stored rows and the rows of a batch with ``_keep``, and the sign that a row has as a change.

    Both carry their folder. One shuffle by folder serves the comparison of equal keys and leaves
    every folder in one task, which writes one file of it.
    """
    both = stored.withColumn("_comes", F.lit(0)).unionByName(batch.withColumn("_comes", F.lit(1)))
    same = Window.partitionBy(BUCKET, *keys)
    first = F.row_number().over(same.orderBy(*[c.desc() for c in [*newest, F.col("_comes")]])) == 1
    contested = F.max("_comes").over(same) == 1
    rows = both.repartition(BUCKET).withColumns({"_first": first, "_contested": contested})
    sign = F.when(F.col("_first") & (F.col("_comes") == 1), 1).when(
        ~F.col("_first") & F.col("_contested") & (F.col("_comes") == 0), -1
    )
    return rows.withColumns({"_keep": F.col("_first") | ~F.col("_contested"), SIGN: sign}).drop(
        "_first", "_contested", "_comes"
    )


def _match(stored: DataFrame, incoming: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Stored rows with (left_semi) or without (left_anti) an incoming key; NULL equals NULL."""
    wanted = incoming.select(*[F.col(k).alias(f"_in_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_in_{k}")) for k in keys]
    return stored.join(wanted, reduce(lambda a, b: a & b, same), how)


def _touched(stored: DataFrame, batch: DataFrame, parts: list[str]) -> DataFrame:
    """Stored rows in the partitions of the batch.

    The least and greatest value per partition column reach the driver, so that the scan
    skips the other folders; the join then keeps the exact partitions.
    """
    ends = [f(p).alias(f"{f.__name__}_{p}") for p in parts for f in (F.min, F.max)]
    bounds = batch.agg(*ends).first()
    for p in parts:
        inside = F.col(p).between(F.lit(bounds[f"min_{p}"]), F.lit(bounds[f"max_{p}"]))
        stored = stored.filter(inside | F.col(p).isNull())
    return _match(stored, batch.select(*parts).distinct(), parts, "left_semi")


def load(
    incoming: DataFrame,
    path: str,
    mode: str = "append",
    primary_key: list[str] | None = None,
    newest: list[str] | None = None,
    partition_by: list[str] | None = None,
    buckets: int | None = None,
    changes: str | None = None,
) -> LoadResult:
    """Write ``incoming`` (with ``_loaded_at``) to the table at ``path``.

    ``merge`` with ``partition_by`` inside the primary key, or with ``buckets``, rewrites only the
    folders of incoming keys, since a key cannot move to another one. ``buckets`` takes the place of
    ``partition_by``, stays the same over the life of a table, and is chosen so that a folder fits a task.
    ``changes`` (with ``buckets``, for append and merge) names a folder that gets the rows put in with
    ``_sign`` 1 and those taken out with -1, before the table changes; where it is whole already,
    the load is a retry and leaves it as it is.
    """
    if mode not in MODES:
        raise ValueError(f"unknown load mode '{mode}', use one of {', '.join(MODES)}")
    if buckets and (partition_by or not primary_key):
        raise ValueError("buckets need a primary_key and no partition_by")
    if changes and (not buckets or mode == "replace"):
        raise ValueError("changes are kept of appends and merges into a table with buckets")
    spark = incoming.sparkSession
    stored = existing(spark, path)
    if buckets:
        incoming = incoming.withColumn(BUCKET, bucket_of(primary_key, buckets))
        partition_by = [BUCKET]
        _guard_buckets(stored, primary_key, buckets, path)
    if stored is not None and mode != "replace":
        guard_schema(stored, incoming, path)

    counted = Observation()
    incoming = incoming.observe(counted, F.count(F.lit(1)).alias("rows"))
    parts = partition_by or []
    if mode == "append":
        rows = incoming if stored is None else incoming.select(*stored.columns)
        if buckets:
            rows = rows.repartition(BUCKET)
        if changes:
            # The table gets what the change set says, so that the source is read once.
            _keep_changes(rows.withColumn(SIGN, F.lit(1)), changes)
            rows = spark.read.parquet(changes).drop(SIGN)
            counted = Observation()
            rows = rows.observe(counted, F.count(F.lit(1)).alias("rows"))
            rows = rows.withColumn(BUCKET, bucket_of(primary_key, buckets)).repartition(BUCKET)
        rows.write.mode("append").partitionBy(*parts).parquet(path)
    elif mode == "replace":
        rows = incoming.repartition(BUCKET) if buckets else incoming
        _overwrite(rows, path, parts, "static")
    elif buckets:
        order = [F.col(c) for c in ["_loaded_at", *(newest or [])]]
        batch = cut_lineage(latest_per_key(incoming, primary_key, order))
        _merge_buckets(stored, batch, path, primary_key, order, changes)
    else:
        if not primary_key:
            raise ValueError("merge needs a primary_key")
        # A row newer in load time wins; further columns settle equal load times.
        order = [F.col(c) for c in ["_loaded_at", *(newest or [])]]
        batch = latest_per_key(incoming, primary_key, order)
        if stored is None:
            _overwrite(batch, path, parts, "static")
        else:
            batch = cut_lineage(batch)
            narrow = bool(parts) and set(parts) <= set(primary_key)
            if narrow:
                stored = _touched(stored, batch, parts)
            result = merged(stored, batch, primary_key, order)
            if narrow:
                # Spark stages the partitions and moves them when all are written.
                _overwrite(result, path, parts, "dynamic")
            else:
                _swap_in(result, path, parts)
    added = _observed(counted)
    table = existing(spark, path)  # a partitioned table without rows has no files
    return LoadResult(path, mode, added, 0 if table is None else table.count())


def _guard_buckets(stored: DataFrame | None, keys: list[str], buckets: int, path: str) -> None:
    """Refuse another number of folders than the table was made with, by one stored row."""
    if stored is None:
        return
    if BUCKET not in stored.columns:
        raise SchemaMismatch(f"{path}: stored without buckets")
    row = stored.select(BUCKET, bucket_of(keys, buckets).alias("here")).first()
    if row is not None and row[BUCKET] != row["here"]:
        raise SchemaMismatch(f"{path}: stored with another number of buckets than {buckets}")


def _merge_buckets(
    stored: DataFrame | None,
    batch: DataFrame,
    path: str,
    keys: list[str],
    order: list[Column],
    changes: str | None,
) -> None:
    """Merge a batch into the folders of its keys; other folders are neither read nor written."""
    if stored is None:
        rows = batch.repartition(BUCKET)
        if changes:
            _keep_changes(rows.withColumn(SIGN, F.lit(1)), changes)
        _overwrite(rows, path, [BUCKET], "static")
        return
    touched = [r[0] for r in batch.select(BUCKET).distinct().collect()]
    rows = settled(stored.filter(F.col(BUCKET).isin(touched)), batch, keys, order)
    if changes:
        rows = cut_lineage(rows)
        _keep_changes(rows.filter(F.col(SIGN).isNotNull()).drop("_keep"), changes)
        rows = rows.repartition(BUCKET)
    _overwrite(rows.filter("_keep").drop("_keep", SIGN), path, [BUCKET], "dynamic")


def _keep_changes(rows: DataFrame, path: str) -> None:
    fs, at = _file_system(rows.sparkSession, path)
    if not fs.exists(at(f"{path}/_SUCCESS")):
        rows.drop(BUCKET).write.mode("overwrite").parquet(path)


def _swap_in(df: DataFrame, path: str, parts: list[str]) -> None:
    """Write a table that is also read: once, beside the old one, then change places.

    A failed write leaves the old table where it was. Between the two renames the old
    table stands under its aside name, from which ``existing`` brings it back.
    """
    spark = df.sparkSession
    _overwrite(df, path + _NEXT, parts, "static")
    fs, at = _file_system(spark, path)
    fs.delete(at(path + _ASIDE), True)
    fs.rename(at(path), at(path + _ASIDE))
    fs.rename(at(path + _NEXT), at(path))
    fs.delete(at(path + _ASIDE), True)
    spark.catalog.refreshByPath(path)


def _overwrite(df: DataFrame, path: str, parts: list[str], scope: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", scope).partitionBy(*parts).parquet(
        path
    )


def run_ingest(
    spark: SparkSession, spec: dict, root: str, as_of: datetime, backfill: bool = False
) -> LoadResult:
    """Scan the source of ``spec``, stamp it and load it into ``root/<table>``.

    A spec with ``source.since_column`` loads the last ``source.days`` (7) days
    unless ``backfill`` is set.
    """
    target = spec["target"]
    rows = scan_source(spark, spec)
    since = spec["source"].get("since_column")
    if since and not backfill:
        rows = last_days(rows, since, as_of, int(spec["source"].get("days", 7)))
    key = target.get("primary_key")
    return load(
        stamp_loaded(rows, as_of),
        f"{root}/{target['table']}",
        target.get("mode", "append"),
        [key] if isinstance(key, str) else key,
        target.get("newest"),
        target.get("partition_by"),
        target.get("buckets"),
    )


def csv_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """The CSV files (or folders named like one) of a folder, by their name without the ending."""
    fs, at = _file_system(spark, folder)
    found = [s.getPath() for s in fs.globStatus(at(f"{folder}/*.csv"))]
    return {p.getName().removesuffix(".csv"): p.toString() for p in found}


def load_folder(
    spark: SparkSession, source: str | dict[str, str], root: str, as_of: datetime
) -> None:
    """Replace one table per CSV of a folder, or per entry of ``{table name: csv path}``."""
    paths = csv_files(spark, source) if isinstance(source, str) else source
    for table, path in sorted(paths.items()):
        spec = {
            "source": {"type": "csv", "path": path},
            "target": {"table": table, "mode": "replace"},
        }
        run_ingest(spark, spec, root, as_of)


def transform_sql(spark: SparkSession, text: str, root: str) -> DataFrame:
    """The rows of a transform's SQL text, whose table names are the folders under ``root``.

    The names live in a session of their own, so that two roots do not meet.
    """
    session = spark.newSession()
    fs, at = _file_system(spark, root)
    for status in fs.listStatus(at(root)):
        name = status.getPath().getName()
        if status.isDirectory() and name.isidentifier() and not name.endswith((_NEXT, _ASIDE, FILES)):
            stored = existing(session, f"{root}/{name}")
            if stored is not None:
                stored.createOrReplaceTempView(name)
    return session.sql(text)


def _observed(counted: Observation) -> int:
    """Rows that were counted; Spark leaves the counting out of a plan that it knows to be empty."""
    try:
        return int(counted.get["rows"])
    except Py4JJavaError:
        return 0


def materialise(mart: DataFrame, path: str) -> int:
    """Full rebuild of a mart table; running it again gives the same table. Returns its rows."""
    counted = Observation()
    rows = mart.observe(counted, F.count(F.lit(1)).alias("rows"))
    _overwrite(rows, path, [], "static")
    return _observed(counted)


def run_everything(
    spark: SparkSession,
    specs: dict[str, dict],
    marts: dict,
    root: str,
    as_of: datetime,
    backfill: bool = False,
) -> dict[str, int]:
    """Every ingest in name order, then every mart in name order; no dependency graph.

    ``marts`` maps a table name to the SQL text of its transform, or to
    ``f(read, as_of) -> DataFrame`` where ``read(table)`` opens a table under ``root``.
    """
    rows = {}
    for name in sorted(specs):
        rows[target_table(name, specs[name])] = run_ingest(
            spark, specs[name], root, as_of, backfill
        ).rows_in_table
    for name in sorted(marts):
        if isinstance(marts[name], str):
            mart = transform_sql(spark, marts[name], root)
        else:
            mart = marts[name](lambda table: spark.read.parquet(f"{root}/{table}"), as_of)
        rows[name] = materialise(mart, f"{root}/{name}")
    return rows
