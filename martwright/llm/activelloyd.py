"""Codes of vectors by product quantisation, its codebooks improved by active-entry Lloyd rounds.

Vectors are scaled to integers and cut into ``parts`` consecutive parts; each part is coded by the nearest of
``entries`` codebook entries of its place. Each part keeps the entry it was assigned and the exact squared
distance to it. After the entries were replaced by the means of their parts, a part whose own entry stayed
the same need not look at other entries that stayed: they were not nearer before. It compares the entries that
moved with its stored distance; the other parts rescan the whole codebook. Both ways a tie goes to the
lower index. All arithmetic is on integers, so neither the order of rows nor their partitions change a result.

Every pass reads the integer vectors with their state once and writes them with the new state; the table of the
pass before is not read again. Sums and counts of an entry are added up in the task first, so a pass
shuffles a row per task, part and entry, and the driver gets ``parts * entries`` rows. Nothing is fitted on a
sample: every vector counts in every round.

Defined results: vectors that are null or hold null or non-finite components are left out; all vectors are
filled up with zeros to one length, the least multiple of ``parts`` that the longest one fits in; a scaled
component beyond 2^25 is taken as 2^25, so that no distance overflows; fewer vectors than ``entries`` give as
many entries; equal ids start the codebook in the order of their vectors, missing ids come last; rows without a label
share a label; repeated rows count each; an empty table gives an empty table and empty codebooks; other columns are
left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import cut_lineage, ship

ship(__name__)
LARGEST = 1 << 25
BLOCK = 2048


@dataclass
class Compressed:
    """``codes`` has one row per vector: id, label, code (list of entry indexes), error.

    ``codebooks`` is an integer array (part, entry, component).
    """

    codes: DataFrame
    codebooks: np.ndarray

    @property
    def sha256(self) -> str:
        """Of all components in order of part, entry and place, joined by commas."""
        text = ",".join(map(str, self.codebooks.ravel().tolist()))
        return hashlib.sha256(text.encode()).hexdigest()


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    good = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(good, F.lit(False))


def scaled(vectors: pa.ListArray, width: int, scale: float) -> np.ndarray:
    """Rows of ``floor(scale * x)``, filled up with zeros to ``width``."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), dtype=np.int64)
    with np.errstate(over="ignore"):
        out[np.arange(width) < size[:, None]] = np.clip(np.floor(flat * scale), -LARGEST, LARGEST)
    return out


def rescan(cut: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, distance) of the nearest entry of every part; ``cut`` is (row, part, component)."""
    entry = np.zeros(cut.shape[:2], dtype=np.int64)
    distance = np.empty(cut.shape[:2], dtype=np.int64)
    for part, book in enumerate(books):
        gap = cut[:, part, None, :] - book
        far = np.einsum("nec,nec->ne", gap, gap)
        entry[:, part] = far.argmin(axis=1)
        distance[:, part] = far.min(axis=1)
    return entry, distance


def reassign(
    cut: np.ndarray, books: np.ndarray, moved: np.ndarray, entry: np.ndarray, distance: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """As ``rescan``, from the assignment to the books before, of which ``moved`` entries changed."""
    entry, distance = entry.copy(), distance.copy()
    for part, book in enumerate(books):
        active = np.flatnonzero(moved[part])
        if not len(active):
            continue
        lost = moved[part][entry[:, part]]
        rows = np.flatnonzero(lost)
        if len(rows):
            found = rescan(cut[rows, part : part + 1], books[part : part + 1])
            entry[rows, part], distance[rows, part] = found[0][:, 0], found[1][:, 0]
        rows = np.flatnonzero(~lost)
        if not len(rows):
            continue
        gap = cut[rows, part, None, :] - book[active]
        far = np.einsum("nec,nec->ne", gap, gap)
        best = far.argmin(axis=1)
        near, index = far[np.arange(len(rows)), best], active[best]
        own, at = distance[rows, part], entry[rows, part]
        better = (near < own) | ((near == own) & (index < at))
        entry[rows[better], part] = index[better]
        distance[rows[better], part] = near[better]
    return entry, distance


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    ends = np.arange(len(rows) + 1) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(rows.ravel(), kind))


def _array(column: pa.ListArray, n: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(n, -1)


def _first_pass(books: np.ndarray, width: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            rows = scaled(batch.column(2), width, scale)
            cut = rows.reshape(len(rows), len(books), -1)
            yield _state(batch, rows, *rescan(cut, books))

    return run


def _next_pass(books: np.ndarray, moved: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            rows, entry, distance = (_array(batch.column(i), batch.num_rows) for i in (2, 3, 4))
            cut = rows.reshape(len(rows), len(books), -1)
            yield _state(batch, rows, *reassign(cut, books, moved, entry, distance))

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK):
            yield batch.slice(first, BLOCK)


def _state(batch, rows, entry, distance) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            batch.column(1),
            _lists(rows, pa.int32()),
            _lists(entry, pa.int32()),
            _lists(distance, pa.int64()),
        ],
        names=["id", "label", "v", "code", "distance"],
    )


def _sums(shape: tuple[int, int, int]):
    """Rows (v, code) to rows (part, entry, n, total) of the task."""
    parts, entries, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), dtype=np.int64)
        total = np.zeros(shape, dtype=np.int64)
        for batch in _blocks(batches):
            rows, entry = (_array(batch.column(i), batch.num_rows) for i in (0, 1))
            cut = rows.reshape(len(rows), parts, width)
            for part in range(parts):
                np.add.at(count[part], entry[:, part], 1)
                np.add.at(total[part], entry[:, part], cut[:, part])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part.astype(np.int32)),
                pa.array(entry.astype(np.int32)),
                pa.array(count[part, entry]),
                _lists(total[part, entry], pa.int64()),
            ],
            names=["part", "entry", "n", "total"],
        )

    return run


def replaced(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry replaced by the floor of the mean of its parts."""
    width = books.shape[2]
    sums = (
        state.select("v", "code")
        .mapInArrow(_sums(books.shape), "part int, entry int, n long, total array<long>")
        .groupBy("part", "entry")
        .agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[c]).alias(f"t{c}") for c in range(width)))
    )
    out = books.copy()
    for r in sums.collect():
        out[r["part"], r["entry"]] = [r[f"t{c}"] // r["n"] for c in range(width)]
    return out


def compress(
    vectors: DataFrame,
    *,
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
) -> Compressed:
    """Codes of all vectors and the codebooks that they refer to."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    good = vectors.where(finite(F.col(vector_col))).select(
        F.col(id_col).alias("id"),
        label.alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    longest = good.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts))
    # The first entries: one bounded list, the smallest ids of each task and then of all.
    first = good.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = pa.array([r["v"] for r in first], pa.list_(pa.float64()))
    start = scaled(start, width * parts, scale).reshape(len(first), parts, width)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    kinds = {f.name: f.dataType.simpleString() for f in good.schema.fields}
    schema = f"id {kinds['id']}, label {kinds['label']}, v array<int>, code array<int>, distance array<long>"
    if not len(first):
        empty = good.sparkSession.createDataFrame([], schema)
        return Compressed(_coded(empty, id_col, label_col), books)
    state = cut_lineage(good.mapInArrow(_first_pass(books, width * parts, scale), schema))
    for _ in range(rounds):
        better = replaced(state, books)
        moved = (better != books).any(axis=2)
        books = better
        state = cut_lineage(state.mapInArrow(_next_pass(books, moved), schema))
    return Compressed(_coded(state, id_col, label_col), books)


def _coded(state: DataFrame, id_col: str, label_col: str | None) -> DataFrame:
    error = F.aggregate("distance", F.lit(0).cast("long"), lambda a, x: a + x)
    label = [F.col("label").alias(label_col)] if label_col else []
    return state.select(F.col("id").alias(id_col), *label, "code", error.alias("error"))


def _approximate(books: np.ndarray, scale: float):
    """What the integers of an entry stand for: the middle of their steps."""
    values = (books + 0.5) / scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            entry = _array(batch.column(1), batch.num_rows)
            rows = values[np.arange(len(books)), entry].reshape(len(entry), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists(rows, pa.float64())], names=["id", "approx"]
            )

    return run


def decoded(compressed: Compressed, *, scale: float = 256.0, id_col: str = "vec_id") -> DataFrame:
    """(id, approx): the vectors that the codes stand for."""
    kind = compressed.codes.schema[id_col].dataType.simpleString()
    rows = compressed.codes.select(F.col(id_col).alias("id"), "code")
    out = rows.mapInArrow(_approximate(compressed.codebooks, scale), f"id {kind}, approx array<double>")
    return out.withColumnRenamed("id", id_col)


def with_label_errors(codes: DataFrame, *, label_col: str = "label") -> DataFrame:
    """Adds ``label_error``: the errors summed over equal labels, missing ones together; null beyond a long.

    The sums are written first, so that Spark knows their size when it plans the join: few labels are
    broadcast, and of many a hot one can be split.
    """
    total = F.sum(F.col("error").cast("decimal(20,0)")).try_cast("long")
    sums = cut_lineage(codes.groupBy(F.col(label_col).alias("__label")).agg(total.alias("label_error")))
    return codes.join(sums, F.col(label_col).eqNullSafe(F.col("__label")), "left").drop("__label")
