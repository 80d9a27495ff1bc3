"""Structured Streaming forms of the append ingest and of the daily checks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from threading import Event

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from martwright.functions.values import PASSED, WARNING, instant
from martwright.sources.files import stamp_loaded

_REPORT_SECONDS = 300
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


@dataclass(frozen=True)
class StreamRun:
    rows_in: int
    rows_too_late: int


def run_row(spark: SparkSession, name: str, run: StreamRun, as_of: datetime) -> DataFrame:
    """The outcome of a stream as a run row, so that rows lost to the watermark are on record."""
    rows = [(name, WARNING if run.rows_too_late else PASSED, run.rows_in, run.rows_too_late)]
    schema = "metric_name string, status string, row_count bigint, rows_too_late bigint"
    return spark.createDataFrame(rows, schema).withColumn("started_at", instant(as_of))


def utc_instant(column: str) -> Column:
    """A zone-free time read as UTC: watermarks and windows need an instant."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), F.col(column)))


class _Tally(StreamingQueryListener):
    """Adds up every batch of one query as it is reported; the stored list of batches is short."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = defaultdict(int)
        self.late: dict[str, int] = defaultdict(int)
        self.ended: dict[str, Event] = defaultdict(Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run = str(progress.runId)
        self.rows[run] += progress.numInputRows
        self.late[run] += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()


def _finish(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamRun:
    """Run a query to its end and count its rows, batch by batch."""
    tally = _Tally()
    spark.streams.addListener(tally)
    try:
        query = start()
        query.awaitTermination()
        run = str(query.runId)
        if not tally.ended[run].wait(_REPORT_SECONDS):
            raise TimeoutError("the batches of the stream were not reported")
    finally:
        spark.streams.removeListener(tally)
    return StreamRun(tally.rows[run], tally.late[run])


def stream_append(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    as_of: datetime,
    file_format: str = "parquet",
) -> StreamRun:
    """Append the files of the folder not loaded yet, then stop. A second run adds nothing."""
    reader = spark.readStream.schema(schema).format(file_format)
    if file_format == "csv":
        reader = reader.option("header", True).option("escape", '"')
    rows = stamp_loaded(reader.load(source), as_of)
    return _finish(
        spark,
        lambda: rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target),
    )


def stream_daily_checks(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    time_column: str = "ts",
    value_column: str = "value",
    delay: str = "1 hour",
) -> StreamRun:
    """Rows, NULL values and newest time per day, kept up to date in ``target``.

    Update mode with one partition per day: each batch rewrites the days it changed,
    also the newest one, and a replayed batch writes the same rows again. Rows later
    than the watermark are counted in the returned run.
    """
    events = (
        spark.readStream.schema(schema)
        .parquet(source)
        .withColumn("_at", utc_instant(time_column))
        .withWatermark("_at", delay)
    )
    daily = events.groupBy(F.window("_at", "1 day")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(value_column).isNull()).alias("null_values"),
        F.max(time_column).alias("newest"),
    )
    # Window bounds are instants; counting days from the epoch needs no session zone.
    day = F.date_from_unix_date(
        F.floor(F.unix_micros("window.start") / F.lit(86400000000)).cast("int")
    )
    rows = daily.select(day.alias("day"), "row_count", "null_values", "newest")

    def keep(batch: DataFrame, _: int) -> None:
        (
            batch.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(target)
        )

    return _finish(
        spark,
        lambda: rows.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(keep)
        .trigger(availableNow=True)
        .start(),
    )


def set_clock(spark: SparkSession, folder: str, schema: T.StructType, time_column: str, at: datetime) -> None:
    """Put a row that only carries a time into a folder that a stream reads beside its source.

    A watermark follows the rows. When a source falls silent, such a row says that time went on, so that
    the windows before it are over.
    """
    names = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields}
    names[time_column] = instant(at)
    rows = spark.range(1).select(*[c.alias(n) for n, c in names.items()])
    rows.coalesce(1).write.mode("append").parquet(folder)


def _watched(
    spark: SparkSession, source: str, clock: str, schema: T.StructType, max_files: int | None
) -> DataFrame:
    def read(path: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)

    return read(source).unionByName(read(clock))


def stream_abandoned_carts(
    spark: SparkSession,
    source: str,
    clock: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    *,
    key: list[str],
    cart: str,
    checkout: str,
    time_column: str = "ts",
    hours: int = 24,
    delay: str = "1 hour",
    max_files: int | None = None,
) -> StreamRun:
    """Append every cart without a checkout to ``target`` once its window is over, then stop.

    ``cart`` and ``checkout`` are SQL conditions on a row, ``key`` SQL expressions that a cart and its checkout
    share. A checkout counts up to ``hours`` before or after the cart. Both sides carry a watermark, so
    the join forgets a row ``hours`` after it and a cart is written when no checkout in time can come
    any more: when the least watermark of both sides has passed. Rows with the same key within ``hours`` are
    one cart. ``clock`` is a folder as ``set_clock`` fills it; rows without a key there move the
    watermark and are neither carts nor checkouts.
    A second run goes on where the first one stopped; how the rows are cut into batches does not show in
    the target, which holds (key columns as k0, k1, ..) without repeats.
    """
    rows = _watched(spark, source, clock, schema, max_files)
    names = [f"k{i}" for i in range(len(key))]
    tick = reduce(lambda a, b: a & b, [F.expr(k).isNull() for k in key])

    # Text that is never missing: a row of the clock must pass the join's own test for missing keys.
    spelled = F.to_json(F.array(*[F.expr(k).cast("string") for k in key]))

    def side(condition: str, at: str, *more: Column) -> DataFrame:
        wanted = rows.where(F.coalesce(F.expr(condition), F.lit(False)) | tick)
        return wanted.select(spelled.alias(f"{at}_key"), utc_instant(time_column).alias(at), *more)

    span = f"INTERVAL {hours} HOURS"
    # One cart per key and window: the state of a key lasts for the window and the delay.
    kept = [F.expr(k).alias(n) for k, n in zip(key, names, strict=True)]
    carts = (
        side(cart, "cart", *kept)
        .withWatermark("cart", f"{hours} hours")
        .dropDuplicatesWithinWatermark(["cart_key"])
    )
    checkouts = side(checkout, "paid").withWatermark("paid", delay)
    near = F.expr(f"cart_key = paid_key AND paid >= cart - {span} AND paid <= cart + {span}")
    left = (
        carts.join(checkouts, near, "left_outer")
        .where(F.col("paid").isNull() & reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names]))
        .select(*names)
    )
    return _finish(
        spark,
        lambda: left.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target),
    )


def stream_distinct_append(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    *,
    key: list[str],
    time_column: str = "ts",
    keep: str = "2 days",
    max_files: int | None = None,
) -> StreamRun:
    """Append rows whose key did not come before, then stop.

    The state holds the keys of the last ``keep`` up to the newest row; an event that is delivered again
    within that time counts once, also across files and runs, and rows older than that are left out
    and counted as too late. Rows without any key are all kept.
    """
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(source)
    missing = reduce(lambda a, b: a & b, [F.col(k).isNull() for k in key])
    # A row without a key gets one of its own.
    rows = rows.withColumns(
        {"_at": utc_instant(time_column), "_own": F.when(missing, F.expr("uuid()")).otherwise("")}
    )
    once = rows.withWatermark("_at", keep).dropDuplicatesWithinWatermark([*key, "_own"])
    return _finish(
        spark,
        lambda: once.drop("_at", "_own")
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target),
    )
