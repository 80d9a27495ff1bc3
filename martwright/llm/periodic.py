"""Periodic runs of words by enumerating maximal pairs.

A run is a stretch of words with smallest period q, at least ``max(min_words, repeats * q)`` long, that
neither neighbour extends. Its first word and the word q later start the same words for exactly
``length - q`` words, and the words before them differ: a maximal pair of distance q. The other way
round, a maximal pair whose common words number ``(repeats - 1) * q`` or more is a run, so nothing has to be
extended; pairs whose distance is a multiple of the period give the same stretch and the smallest
distance is kept.

The suffixes of a document are sorted by doubling the compared depth; only those that share
their first ``depth`` words with another one (no shorter common part can be a run) enter the tree of
LCP intervals, which is walked from the leaves up. A node keeps its positions in text order, each with the
class of the word to its left, and the smaller list of two children is merged into the larger. Positions
no farther apart than half of the node's depth stand one period apart, so of them only the first can be of another
class than the rest: a look at the first and the next position of that reach finds every maximal pair, however long
the class lists are.

Documents are worked on in blocks of about a megabyte, or one by one if longer; memory is some 4 bytes a
word for each doubling of the compared depth. Words are compared by 64-bit digests.

Defined results: words are what space, tab, line feed, vertical tab, form feed and carriage return part; a null,
empty or blank text has no words, no runs and nothing kept; repeated rows give a row each; null ids are handed on;
an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import ship
from martwright.llm.textarrays import Rolling, U, blocks, mix, text_column

ship(__name__)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, digests and documents of the words between blanks; they end with their document."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = ~_BLANK[data]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    last = inside[:-1] & ~inside[1:]
    cuts = cuts[cuts > 0]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = Rolling(data).of(starts, ends)
    return starts, ends, hashes, np.searchsorted(offsets, starts, side="right") - 1


def windows_met_again(hashes: np.ndarray, docs: np.ndarray, depth: int) -> np.ndarray:
    """Documents with a stretch of ``depth`` words that starts at two places."""
    n = len(hashes) - depth + 1
    if n <= 0:
        return np.empty(0, docs.dtype)
    acc = np.zeros(n, dtype=U)
    for k in range(depth):
        acc = acc * U(0x9FB21C651E98DF25) + hashes[k : k + n]
    own = docs[:n]
    fits = own == docs[depth - 1 :]
    tagged = mix(acc[fits]) ^ mix(own[fits].astype(U))
    order = np.argsort(tagged)
    again = np.flatnonzero(tagged[order][1:] == tagged[order][:-1])
    return np.unique(own[fits][order[again]])


def sorted_suffixes(hashes: np.ndarray, docs: np.ndarray, depth: int):
    """(positions, lcp): suffixes that share ``depth`` words with another of their document, sorted.

    ``lcp[i]`` is what position i has in common with the one before it, 0 where that is
    less than ``depth``. Two ends of text are never equal.
    """
    n = len(hashes)
    limit = np.searchsorted(docs, docs, side="right")
    _, word = np.unique(hashes, return_inverse=True)
    order = np.lexsort((word, docs))
    fresh = np.append(True, (word[order][1:] != word[order][:-1]) | (docs[order][1:] != docs[order][:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels = [rank.astype(np.int32)]
    size = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(size[rank] > 1)
    reach, met = 1, None
    while len(open_):
        if met is None and 2 * reach > depth:
            met = open_
        ahead = open_ + reach
        second = np.where(ahead < limit[open_], rank[np.minimum(ahead, n - 1)], -1)
        first = rank[open_]
        order = np.lexsort((second, first))
        first, second, open_ = first[order], second[order], open_[order]
        head = np.append(True, first[1:] != first[:-1])
        fresh = head | np.append(True, second[1:] != second[:-1])
        at = np.arange(len(open_))
        group = np.maximum.accumulate(np.where(head, at, 0))
        part = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[open_] = first + part - group
        levels.append(rank.astype(np.int32))
        reach *= 2
        alone = fresh & np.append(fresh[1:], True)
        open_ = open_[~alone]
    if met is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    positions = met[np.argsort(rank[met], kind="stable")]
    a, b = positions[:-1], positions[1:]
    common = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < limit[a]) & (y < limit[b])
        level = levels[k]
        same = level[np.minimum(x, n - 1)] == level[np.minimum(y, n - 1)]
        common += np.where(inside & same, 1 << k, 0)
    common[(common < depth) | (docs[a] != docs[b])] = 0
    return positions, np.append(0, common)


def maximal_pairs(
    positions: list[int], lcp: list[int], left: list[int], reach: int
) -> Iterator[tuple[int, int, int]]:
    """(i, j, common words) of the maximal pairs with ``reach * (j - i)`` common words or more.

    ``left`` is the class of the word before each position.
    """
    if not positions:
        return
    stack: list[tuple[int, list[int]]] = []  # depth and positions of the open intervals

    def merged(depth: int, one: list[int], other: list[int]):
        small, large = (one, other) if len(one) < len(other) else (other, one)
        far = depth // reach
        for x in small:
            own = left[x]
            k = bisect_left(large, x - far)
            if k < len(large) and large[k] < x and left[large[k]] != own:
                yield large[k], x, depth
            k = bisect_right(large, x)
            while k < len(large) and large[k] <= x + far and left[large[k]] != own:
                yield x, large[k], depth
                k += 1
        for x in small:
            insort(large, x)
        return large

    done = positions[:1]  # the finished subtree left of the common part looked at
    for position, depth in zip([*positions[1:], -1], [*lcp[1:], 0], strict=True):
        while stack and stack[-1][0] > depth:
            level, before = stack.pop()
            done = yield from merged(level, before, done)
        if stack and stack[-1][0] == depth:
            stack[-1] = (depth, (yield from merged(depth, stack[-1][1], done)))
        elif depth:
            stack.append((depth, done))
        done = [position]


def runs_of(hashes: np.ndarray, docs: np.ndarray, min_words: int, repeats: int):
    """{document: [(start, length, period)]}, starts counted from the first word given."""
    depth = -(-min_words * (repeats - 1) // repeats)
    found: dict[int, dict[tuple[int, int], int]] = {}
    keep = np.isin(docs, windows_met_again(hashes, docs, depth))
    place = np.flatnonzero(keep)
    if not len(place):
        return {}
    hashes, docs = hashes[place], docs[place]
    positions, lcp = sorted_suffixes(hashes, docs, depth)
    _, word = np.unique(hashes, return_inverse=True)
    left = np.append(-1, word[:-1])
    left[np.append(True, docs[1:] != docs[:-1])] = -1
    for i, j, common in maximal_pairs(positions.tolist(), lcp.tolist(), left.tolist(), repeats - 1):
        period = j - i
        if common + period < min_words:
            continue
        stretches = found.setdefault(int(docs[i]), {})
        stretch = (int(place[i]), common + period)
        stretches[stretch] = min(period, stretches.get(stretch, period))
    return {
        doc: sorted((start, length, q) for (start, length), q in stretches.items())
        for doc, stretches in found.items()
    }


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _scan(min_words: int, repeats: int, with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_column(batch.column(1))
            counts, runs, kept, digests = [], [], [], []
            for low, high in blocks(offsets):
                at = offsets[low : high + 1] - offsets[low]
                part = data[offsets[low] : offsets[high]]
                starts, ends, hashes, docs = spaced_words(part, at)
                count = np.bincount(docs, minlength=high - low)
                begin = np.cumsum(count) - count
                found = runs_of(hashes, docs, min_words, repeats)
                raw = part.tobytes()
                begins, finishes = starts.tolist(), ends.tolist()
                for doc in range(high - low):
                    first, n = int(begin[doc]), int(count[doc])
                    own = [(s - first, length, q) for s, length, q in found.get(doc, ())]
                    stay = np.ones(n, dtype=bool)
                    for s, length, q in own:
                        stay[s + q : s + length] = False
                    text = b" ".join(
                        raw[begins[w] : finishes[w]] for w in (np.flatnonzero(stay) + first).tolist()
                    )
                    counts.append(n)
                    runs.append([{"start": s, "length": m, "period": q} for s, m, q in own])
                    digests.append(hashlib.sha256(text).hexdigest())
                    kept.append(text if with_kept else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(runs, _RUNS),
                    pa.array(digests, pa.string()),
                    pa.array(kept, pa.binary()),
                ],
                names=["id", "n_words", "runs", "kept_sha256", "kept"],
            )

    return run


def find_runs(
    docs: DataFrame,
    *,
    min_words: int = 24,
    repeats: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_kept: bool = True,
) -> DataFrame:
    """One row per row: id, n_words, runs by start and period, digest and text of the words kept.

    Of every run the first period is kept; kept words are joined by one space (UTF-8).
    """
    if repeats < 3 or min_words < repeats:
        raise ValueError("a run has at least three periods, each of a word or more")
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(
        _scan(min_words, repeats, with_kept),
        f"id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>,"
        " kept_sha256 string, kept binary",
    )
    out = out if with_kept else out.drop("kept")
    return out.withColumnRenamed("id", id_col)
