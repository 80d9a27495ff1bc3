"""Language by rank-order profiles of character n-grams.

The n-grams of one to three characters are counted inside words, with a blank on either side of each word.
A language's profile is the ranked list of its ``top`` most frequent n-grams over all labelled texts,
a document's profile that of its own. The distance of a document to a language adds, for each of its ranked n-grams,
how far out of place it stands in the language's list, and ``top`` where the list lacks it; the nearest
language is predicted. The score is 1 less the mean distance over ``top``: 1 for the same order.

Counts are exact: an n-gram is packed into 63 bits, 21 for each code point. Each task adds up what its rows hold
before anything is shuffled, so a language with most of the rows is one row per n-gram and task, and the
rank filter runs before the shuffle of the ranking. The model has ``max_langs`` times ``top`` entries at most
(beyond ``max_langs`` labels, those of the most documents are learned). Long texts are counted piece by piece.

Letters are the Unicode letters; texts are lower-cased; all else parts words. Defined results: a text that is null
or has no letter is ``und`` with score 0, as is every text if nothing was learned; ties go to the n-gram or
language that comes first by code points; bytes that are no UTF-8 part words; repeated rows give a row each; null ids are handed
on; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.common import ship

ship(__name__)
PIECE = 1 << 20  # characters counted at once
FLUSH = 1 << 21  # n-grams a task holds before it adds them up
UNKNOWN = "und"


class _Letters(dict):
    """For every code point whether it is a letter; kept where it is filled."""

    def __reduce__(self):
        return _Letters, ()

    def of(self, points: np.ndarray) -> np.ndarray:
        if not self:
            self["known"] = np.full(0x110000, -1, dtype=np.int8)
        known = self["known"]
        found = known[points]
        fresh = np.unique(points[found < 0])
        if len(fresh):
            known[fresh] = [chr(p).isalpha() for p in fresh.tolist()]
            found = known[points]
        return found == 1


_LETTERS = _Letters()


def added_up(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, each with the sum of its counts."""
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    head = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else order
    return grams[head], np.add.reduceat(counts, head) if len(head) else counts


def _count(stream: np.ndarray, tail: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that start in all but the last ``tail`` places of a stream of letters and blanks."""
    padded = np.append(stream, np.zeros(max(0, 2 - tail), np.int64))
    n = len(stream) - tail
    a, b, c = padded[:n], padded[1 : n + 1], padded[2 : n + 2]
    one = a[a != 32] << 42
    two = (a << 42 | b << 21)[b != 0]
    three = (a << 42 | b << 21 | c)[(b != 32) & (c != 0)]
    grams = np.sort(np.concatenate([one, two, three]))
    head = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else grams
    return grams[head], np.diff(np.append(head, len(grams)))


def ngrams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text in order of code points, and how often each occurs."""
    lowered = (text or b"").decode("utf-8", "replace").lower()
    points = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    stream = np.full(len(points) + 2, 32, dtype=np.int64)
    stream[1:-1][_LETTERS.of(points)] = points[_LETTERS.of(points)]
    stream = stream[np.append(True, (stream[1:] != 32) | (stream[:-1] != 32))]
    if len(stream) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    parts = []
    for begin in range(0, len(stream), PIECE):
        piece = stream[begin : begin + PIECE + 2]
        parts.append(_count(piece, max(0, len(piece) - PIECE)))
    if len(parts) == 1:
        return parts[0]
    return added_up(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to rows (lang, gram, n), added up within the task."""
    held: dict[str, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, counts = added_up(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                names=["lang", "gram", "n"],
            )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = ngrams(text.as_py())
            held.setdefault(lang, []).append(part)
            size += len(part[0])
            if size > FLUSH:
                held = {
                    k: [added_up(*(np.concatenate(x) for x in zip(*v, strict=True)))]
                    for k, v in held.items()
                }
                size = sum(len(v[0][0]) for v in held.values())
                if size > FLUSH // 2:
                    yield from flush()
                    held, size = {}, 0
    yield from flush()


@dataclass
class Profiles:
    """Languages in order, all their n-grams in order, and ranks (n-gram, language); ``top`` is none."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    top: int


def fit(texts: DataFrame, *, top: int = 300, max_langs: int = 1000) -> Profiles:
    """Profiles of the languages of ``texts`` (lang, text); rows without a language teach nothing."""
    labelled = texts.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text"))
    labelled = labelled.where("lang is not null and text is not null")
    known = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs)
    known = [r["lang"] for r in known.select("lang").collect()]
    counts = (
        labelled.where(F.col("lang").isin(known))
        .mapInArrow(_frequencies, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(by_count) - 1).where(F.col("rank") < top)
    rows = ranked.select("lang", "gram", "rank").collect()
    langs = sorted({r["lang"] for r in rows})
    grams = np.unique(np.array([r["gram"] for r in rows], dtype=np.int64))
    ranks = np.full((len(grams), len(langs)), top, dtype=np.int32)
    place = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        ranks[np.searchsorted(grams, r["gram"]), place[r["lang"]]] = r["rank"]
    return Profiles(langs, grams, ranks, top)


def distances(text: bytes | None, model: Profiles) -> tuple[np.ndarray, int]:
    """Out-of-place distance to every language, and how many n-grams the document ranks."""
    grams, counts = ngrams(text)
    order = np.argsort(-counts, kind="stable")[: model.top]
    grams = grams[order]
    if not len(model.grams):
        return np.zeros(0, dtype=np.int64), len(grams)
    at = np.minimum(np.searchsorted(model.grams, grams), len(model.grams) - 1)
    have = model.grams[at] == grams
    ranks = model.ranks[at[have]]
    own = np.flatnonzero(have)[:, None]
    gap = np.where(ranks == model.top, model.top, np.abs(ranks - own))
    return gap.sum(axis=0) + model.top * int(len(grams) - have.sum()), len(grams)


def _predict(model: Profiles, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(0):
                far, n = distances(text.as_py(), model)
                if not n or not len(far):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(np.argmin(far))
                langs.append(model.langs[best])
                scores.append(1.0 - int(far[best]) / (n * model.top))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i + 1) for i in range(carried)),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                ],
                names=[*batch.schema.names[1:], "lang_pred", "score"],
            )

    return run


def predict(
    docs: DataFrame, model: Profiles, *, text_col: str = "text", carry: Mapping[str, Column] | None = None
) -> DataFrame:
    """The columns of ``carry`` with ``lang_pred`` and ``score``: one row per row."""
    kept = [column.alias(name) for name, column in (carry or {}).items()]
    rows = docs.select(F.col(text_col).cast("binary").alias("__text"), *kept)
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]
    )
    schema += ", " if kept else ""
    return rows.mapInArrow(_predict(model, len(kept)), schema + "lang_pred string, score double")
