"""Quality classifier: a factorisation machine.

Features of a text are its words, each occurrence a feature in one of ``SLOTS`` hashed slots with the
value one over the number of words; statistics of its structure (shares of kinds of bytes,
word and line lengths, repetition); and its length, measured and as recorded. Every pair of
features interacts through the inner product of their ``RANK`` factors. With s1 the sum of value
times factor and s2 the sum of the squares, all pairs together are (s1^2 - s2) / 2 per factor, so a text
is scored in time linear in its words.

Training minimises the log loss by full-batch Adam steps: each step is one job in which every
partition sends the gradient of its rows, whose size is that of the model. Training rows are a bounded
sample of the labelled rows (``max_rows``, chosen by a hash of the id).

Defined results: null and empty texts have no words and all statistics 0, and get the score of that;
a null or missing recorded length counts as 0; labels that are null are not used; a document id
with several labels has the larger; without usable labels every score is 0.5; an empty
table gives an empty table; other columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from martwright.llm.common import cut_lineage, ship
from martwright.llm.textarrays import U, blocks, text_column, words

ship(__name__)
SLOTS, RANK = 4096, 8

# Kinds of bytes whose shares are statistics.
KINDS = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz",
    b"0123456789",
    b" ",
    b"\n",
    b"\t\r",
    b".,;:?'\"",
    b"!",
    b"|",
    b"$#%&*",
    b"<>{}[]()/\\",
    b"+-=_~^`@",
    bytes(range(128, 256)),
)
N_STATS = len(KINDS) + 7
_KIND_OF = np.full(256, len(KINDS), dtype=np.uint8)
for _i, _kind in enumerate(KINDS):
    _KIND_OF[list(_kind)] = _i


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(data: np.ndarray, at: np.ndarray, recorded: np.ndarray):
    """Slots of all words, words per document and statistics (n, N_STATS) of a block."""
    n = len(at) - 1
    size = np.diff(at).astype(np.float64)
    starts, ends, hashes, of = words(data, at)
    count = np.bincount(of, minlength=n)
    doc = np.repeat(np.arange(n), np.diff(at))
    kinds = np.bincount(doc * (len(KINDS) + 1) + _KIND_OF[data], minlength=n * (len(KINDS) + 1))
    kinds = kinds.reshape(n, -1)[:, : len(KINDS)].astype(np.float64)
    lengths = np.bincount(of, weights=ends - starts, minlength=n)
    order = np.lexsort((hashes, of))
    same = (hashes[order][1:] == hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
    repeated = np.bincount(of[order][1:][same], minlength=n)
    capital = np.bincount(of[_KIND_OF[data[starts]] == 0], minlength=n)
    stats = np.column_stack(
        [
            _share(kinds, size[:, None]),
            _share(kinds[:, 0], kinds[:, 0] + kinds[:, 1]),
            _share(lengths, count) / 10,
            _share(repeated, count),
            _share(capital, count),
            _share(size, kinds[:, 4] + 1) / 1000,
            np.log1p(size) / 10,
            np.log1p(np.maximum(recorded, 0)) / 10,
        ]
    )
    return (hashes & U(SLOTS - 1)).astype(np.int64), count, stats


@dataclass
class Model:
    """Weights (SLOTS + N_STATS), factors (SLOTS + N_STATS, RANK), bias, centre and scale."""

    weights: np.ndarray
    factors: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray

    def forward(self, slots, count, stats):
        """Logits and what the gradient needs."""
        x = np.repeat(_share(1.0, count), count)
        of = np.repeat(np.arange(len(count)), count)
        z = (stats - self.centre) / self.scale
        gathered = self.factors[slots] * x[:, None]
        linear = np.bincount(of, weights=self.weights[slots] * x, minlength=len(count))
        s1, s2 = np.zeros((2, len(count), RANK))
        full = np.flatnonzero(count)
        if len(full):
            begin = (np.cumsum(count) - count)[full]
            s1[full] = np.add.reduceat(gathered, begin, axis=0)
            s2[full] = np.add.reduceat(gathered**2, begin, axis=0)
        dense = self.factors[SLOTS:]
        s1 += z @ dense
        s2 += z**2 @ dense**2
        logit = self.bias + linear + z @ self.weights[SLOTS:] + 0.5 * (s1**2 - s2).sum(axis=1)
        return logit, (x, of, z, gathered, s1)

    def gradient(self, slots, count, stats, label):
        """Sums over the rows: (loss, rows, flat gradient)."""
        logit, (x, of, z, gathered, s1) = self.forward(slots, count, stats)
        chance = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        off = chance - label
        loss = -np.log(np.where(label > 0, chance, 1 - chance) + 1e-12).sum()
        weights, factors = np.zeros_like(self.weights), np.zeros_like(self.factors)
        pull = off[of] * x
        weights[:SLOTS] = np.bincount(slots, weights=pull, minlength=SLOTS)
        weights[SLOTS:] = off @ z
        part = pull[:, None] * (s1[of] - gathered)
        for f in range(RANK):
            factors[:SLOTS, f] = np.bincount(slots, weights=part[:, f], minlength=SLOTS)
        dense = self.factors[SLOTS:]
        factors[SLOTS:] = (z * off[:, None]).T @ s1 - dense * (z**2 * off[:, None]).sum(0)[:, None]
        return loss, len(label), np.concatenate([weights, factors.ravel(), [off.sum()]])


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, recorded, label, draw) to (slots, stats, label, draw)."""
    for batch in batches:
        data, offsets = text_column(batch.column(0))
        recorded = batch.column(1).to_numpy(zero_copy_only=False)
        for first, last in blocks(offsets):
            at = offsets[first : last + 1] - offsets[first]
            slots, count, stats = features(
                data[offsets[first] : offsets[last]], at, recorded[first:last]
            )
            ends = np.append(0, np.cumsum(count)).astype(np.int32)
            lines = np.arange(0, stats.size + 1, N_STATS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(slots.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(lines), pa.array(stats.ravel())),
                    batch.column(2)[first:last],
                    batch.column(3)[first:last],
                ],
                names=["slots", "stats", "label", "draw"],
            )


def _step(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, rows, total = 0.0, 0, 0.0
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                lists = part.column(0)
                ends = lists.offsets.to_numpy()
                slots = lists.values.to_numpy()[ends[0] : ends[-1]]
                stats = part.column(1).flatten().to_numpy().reshape(-1, N_STATS)
                label = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                a, b, g = model.gradient(slots, np.diff(ends), stats, label)
                loss, rows, total = loss + a, rows + b, total + g
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([loss]), pa.array([rows]), pa.array([total.tobytes()], pa.binary())],
                names=["loss", "rows", "gradient"],
            )

    return run


def _recorded(docs: DataFrame, length_col: str) -> Column:
    if length_col not in docs.columns:
        return F.lit(0.0).alias("recorded")
    return F.coalesce(F.col(length_col).cast("double"), F.lit(0.0)).alias("recorded")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    max_rows: int = 20_000,
    steps: int = 40,
    rate: float = 0.08,
    decay: float = 1e-4,
    parts: int = 8,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str = "n_chars",
    label_col: str = "quality",
) -> Model:
    """Train on at most about ``max_rows`` of the rows of ``labels`` (id, label)."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.max(label_col).cast("double").alias("label"))
        .withColumn("draw", F.xxhash64(F.lit(seed), "label_id"))
    )
    share = min(1.0, max_rows / max(known.count(), 1))
    sample = known
    if share < 1:
        sample = known.where(F.col("draw") < F.lit(int((2 * share - 1) * 2.0**62) * 2))
    rows = cut_lineage(
        # bounded by max_rows: two numbers each
        docs.join(F.broadcast(sample), F.col(id_col) == F.col("label_id"))
        .select(F.col(text_col).alias("text"), _recorded(docs, length_col), "label", "draw")
        .mapInArrow(_featurize, "slots array<int>, stats array<double>, label double, draw long")
        .repartition(parts, "draw")
        .sortWithinPartitions("draw")
    )
    # A step sends one gradient a part, as large as the model: no more of them where the rows are in more files.
    # Kept by the executors, so that a step opens no file: every scan broadcasts Hadoop's settings from the driver.
    # A lost part is read from the files again.
    rows = rows.coalesce(parts).persist()
    try:
        return _train(rows, steps, rate, decay, seed)
    finally:
        rows.unpersist()


def _train(rows: DataFrame, steps: int, rate: float, decay: float, seed: int) -> Model:
    """Adam steps over ``rows`` (slots, stats, label), each one job."""
    spots = [F.element_at("stats", i + 1) for i in range(N_STATS)]
    moments = rows.agg(*(F.avg(c) for c in spots), *(F.stddev_pop(c) for c in spots)).first()
    centre = np.array([0.0 if m is None else m for m in moments[:N_STATS]])
    scale = np.array([m if m and m > 1e-9 else 1.0 for m in moments[N_STATS:]])
    size = SLOTS + N_STATS
    draw = np.random.default_rng(seed)
    model = Model(np.zeros(size), draw.normal(0, 0.05, (size, RANK)), 0.0, centre, scale)
    theta = np.concatenate([model.weights, model.factors.ravel(), [model.bias]])
    first, second = np.zeros((2, len(theta)))
    for t in range(1, steps + 1):
        sent = rows.mapInArrow(_step(model), "loss double, rows long, gradient binary").collect()
        n = sum(r["rows"] for r in sent)
        if not n:
            break
        grad = sum(np.frombuffer(r["gradient"]) for r in sent) / n + decay * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta = theta - rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        model = Model(
            theta[:size], theta[size:-1].reshape(size, RANK), float(theta[-1]), centre, scale
        )
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_column(batch.column(0))
            recorded = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last in blocks(offsets):
                at = offsets[first : last + 1] - offsets[first]
                logit, _ = model.forward(
                    *features(data[offsets[first] : offsets[last]], at, recorded[first:last])
                )
                score = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
                rest = [batch.column(i)[first:last] for i in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(score)], names=[*batch.schema.names[2:], "score"]
                )

    return run


def score(
    docs: DataFrame,
    model: Model,
    *,
    carry: dict[str, Column],
    text_col: str = "text",
    length_col: str = "n_chars",
) -> DataFrame:
    """One row per row: the columns of ``carry`` (name to column) and the score, from 0 to 1."""
    rows = docs.select(
        F.col(text_col).cast("string").alias("text"),
        _recorded(docs, length_col),
        *(c.alias(name) for name, c in carry.items()),
    )
    schema = StructType([*rows.schema[2:], StructField("score", DoubleType())])
    return rows.mapInArrow(_score(model), schema)
