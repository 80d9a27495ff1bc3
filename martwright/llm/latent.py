"""Benchmark decontamination by latent semantic retrieval.

1. Every document is read once for how often its terms occur, hashed into ``BUCKETS``. Terms are
   words and pairs of neighbouring words.
2. Every document is read once as passages of ``window`` words, ``stride`` apart. A passage whose
   TF-IDF weight on the terms of a benchmark piece is below ``gate`` of its whole weight cannot reach a
   higher cosine with that piece (but for words that it repeats); ``gate`` is never above ``cosine``. A
   passage that can reach no piece is left there. The others are written down with the words around
   them, once for each group of pieces that they can reach. The weight on a piece is bounded
   from above: terms that more than ``SPREAD`` pieces hold count for every piece.
3. A randomised SVD of their TF-IDF rows and the benchmark's, of which each weighs as much as all
   passages together, so that text which the corpus repeats does not push it out: products with a
   fixed random matrix are summed over partitions, one power step sharpens them, and a small
   eigenproblem gives ``rank`` latent directions. There is one such space for every ``rank``
   benchmark pieces, made of the passages that can reach them, so that no piece is lost to the others.
   As rank and number of pieces are equal and the pieces outweigh the passages, a space keeps its
   pieces whole, and the cosine with one of them is that of their TF-IDF rows.
4. Passages are compared with the benchmark pieces in the latent space; pairs with a cosine of ``cosine``
   or more (of the whole passage with what the space keeps of the piece) are candidates.
5. A candidate is a leak if the heaviest common subsequence of words, each weighing its rarity,
   covers ``exact`` of the piece, or ``loose`` of it while the answer, the last words of the benchmark
   text, is found in order too.

In the same reading every benchmark text shorter than a window is searched for as a phrase, word by word, as it
weighs too little in a passage to be sure of a cosine; one of fewer than ``min_words`` words by that alone.

Benchmark texts are cut into pieces of ``piece`` words, half of it apart. They are taken block by block
(``block_items`` and ``block_chars``), so what goes to the executors is bounded however long the benchmark is; the bucket
tables and the matrices of the SVD are bounded by BUCKETS and the rank.

Defined results: null and word-less documents have no passages; word-less benchmark
texts are not searched for; repeated documents leak each, but show as one row per document,
text and benchmark text; an empty benchmark or table gives an empty table; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from martwright.llm.common import cut_lineage, document_keys, ship, shuffle_width
from martwright.llm.textarrays import U, blocks, mix, text_column, words
from martwright.session import scratch_dir

ship(__name__)
BUCKETS = 1 << 19
SPREAD = 64  # pieces up to which a term is counted for its own pieces only
CELLS = 1 << 22  # (passage, piece) sums held at once


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(20) & U(BUCKETS - 1)).astype(np.int64)


def pair_bucket(hashes: np.ndarray) -> np.ndarray:
    """Of every word with the word after it."""
    return bucket(mix(hashes[:-1] * U(0x9FB21C651E98DF25) + hashes[1:]))


def sum_arrays(parts: DataFrame, length: int, fan_in: int = 16) -> np.ndarray:
    """The sum of all arrays in the binary column ``part``, added up by a tree.

    The first level has a task for every few partitions; one array reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for batch in batches:
            for value in batch.column(0):
                array = value.as_buffer()
                total += np.frombuffer(array, np.float32 if array.size == 4 * length else np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])

    tasks = max(1, shuffle_width(parts.sparkSession) // 8)
    while True:
        parts = parts.repartition(tasks).mapInArrow(run, "part binary")
        if tasks == 1:
            break
        tasks = -(-tasks // fan_in)
    return np.frombuffer(parts.collect()[0]["part"])


def _part(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()])], ["part"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to one array per partition: occurrences per bucket, and all words at the end."""
    total = np.zeros(BUCKETS + 1)
    for batch in batches:
        data, offsets = text_column(pc.utf8_lower(batch.column(0)))
        for first, last in blocks(offsets):
            at = offsets[first : last + 1] - offsets[first]
            _, _, hashes, of = words(data[offsets[first] : offsets[last]], at)
            total[BUCKETS] += len(hashes)
            together = of[1:] == of[:-1]
            terms = np.concatenate([bucket(hashes), pair_bucket(hashes)[together]])
            total[:BUCKETS] += np.bincount(terms, minlength=BUCKETS)
    yield _part(total)


def rarity(docs: DataFrame, text_col: str, window: int, stride: int) -> np.ndarray:
    """Inverse passage frequency of every bucket (float32), over all documents.

    With passages ``stride`` apart an occurrence lies in ``window / stride`` of them.
    """
    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(_frequencies, "part binary")
    counts = sum_arrays(parts, BUCKETS + 1)
    passages = counts[BUCKETS] / stride
    seen = np.minimum(counts[:BUCKETS] * window / stride, passages)
    return (np.log((1 + passages) / (1 + seen)) + 1e-3).astype(np.float32)


@dataclass
class Pieces:
    """Benchmark pieces: number of the owner, words, the owner's last words, and the rarity of both."""

    owner: list[int]
    hashes: list[np.ndarray]
    answer: list[np.ndarray]
    weight: list[np.ndarray]
    answer_weight: list[np.ndarray]


def _words_of(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").lower().encode(), np.uint8)
    return words(data, np.array([0, len(data)]))[2]


def cut_pieces(texts, idf: np.ndarray, piece: int, min_words: int, answer_words: int) -> Pieces:
    out = Pieces([], [], [], [], [])
    for number, text in enumerate(texts):
        hashes = _words_of(text)
        if len(hashes) < min_words:
            continue
        for start in range(0, max(len(hashes) - piece // 2, 1), piece // 2):
            out.owner.append(number)
            out.hashes.append(hashes[start : start + piece])
            out.answer.append(hashes[-answer_words:])
            out.weight.append(idf[bucket(out.hashes[-1])].astype(np.float64))
            out.answer_weight.append(idf[bucket(out.answer[-1])].astype(np.float64))
    return out


class Reach:
    """Which pieces a passage may reach, from the weights of its terms.

    ``place`` numbers the buckets of the pieces' terms. A term of more than ``SPREAD`` pieces is common: its
    weight counts for every piece, so that the bound holds and no list is long.
    """

    def __init__(self, terms: list[np.ndarray], idf: np.ndarray, gate: float, group: int):
        self.slots = np.unique(np.concatenate(terms)) if terms else np.empty(0, np.int64)
        self.place = np.full(BUCKETS, -1, dtype=np.int32)
        self.place[self.slots] = np.arange(len(self.slots))
        self.mass = idf[self.slots].astype(np.float64) ** 2
        self.gate, self.group, self.pieces = gate * gate, group, len(terms)
        own = [np.unique(self.place[t]) for t in terms]
        held = np.concatenate(own) if own else np.empty(0, np.int64)
        piece = np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(held, kind="stable")
        count = np.bincount(held, minlength=len(self.slots))
        self.common = count > SPREAD
        self.low = np.cumsum(count) - count
        self.count = np.where(self.common, 0, count)
        self.piece = piece[order]

    def groups(self, places: np.ndarray, ends: np.ndarray, whole: np.ndarray):
        """(passage, group) of all that may meet; ``ends`` are the offsets of the passages' places."""
        size = np.diff(ends)
        row = np.repeat(np.arange(len(size)), size)
        base = np.bincount(row, np.where(self.common[places], self.mass[places], 0.0), len(size))
        need = self.gate * whole - base
        rows, groups = [], []
        width = -(-self.pieces // self.group)
        step = max(1, CELLS // max(self.pieces, 1))
        for first in range(0, len(size), step):
            last = min(first + step, len(size))
            part = slice(ends[first], ends[last])
            at, ends_at = _ranges(self.low[places[part]], self.low[places[part]] + self.count[places[part]])
            times = np.diff(ends_at)
            cell = np.repeat(row[part] - first, times) * self.pieces + self.piece[at]
            sums = np.bincount(cell, np.repeat(self.mass[places[part]], times), (last - first) * self.pieces)
            meets = sums.reshape(last - first, self.pieces) >= need[first:last, None]
            padded = np.zeros((last - first, width * self.group), dtype=bool)
            padded[:, : self.pieces] = meets
            some = padded.reshape(last - first, width, self.group).any(axis=2)
            i, g = np.nonzero(some)
            rows.append(i + first)
            groups.append(g)
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows), np.concatenate(groups)


class Phrases:
    """Texts that have words, but fewer than a window, to be found word by word."""

    STEP = U(0x9FB21C651E98DF25)

    def __init__(self, texts, window: int):
        self.owners: dict[tuple[int, int], list[int]] = {}
        # Buckets of a single word, or of the first two words.
        self.one, self.two = (np.zeros(BUCKETS, dtype=bool) for _ in range(2))
        for number, text in enumerate(texts):
            hashes = _words_of(text)
            if not 0 < len(hashes) < window:
                continue
            acc = U(0)
            for h in hashes:
                acc = (np.array([acc]) * self.STEP + h)[0]
            self.owners.setdefault((len(hashes), int(acc)), []).append(number)
            if len(hashes) == 1:
                self.one[bucket(hashes)] = True
            else:
                self.two[pair_bucket(hashes)[:1]] = True
        lengths: dict[int, list[int]] = {}
        for n, acc in self.owners:
            lengths.setdefault(n, []).append(acc)
        self.lengths = {n: np.array(sorted(x), dtype=U) for n, x in lengths.items()}

    def found(self, hashes, of, slot, pair, ends) -> list[tuple[int, int, int]]:
        """(document, first word, phrase) of the phrases of a block, each once a document."""
        out: list[tuple[int, int, int]] = []
        if not self.lengths or not len(hashes):
            return out
        start = np.flatnonzero(self.one[slot] | self.two[pair])
        acc = np.zeros(len(start), dtype=U)
        for n in range(1, max(self.lengths) + 1):
            fits = start + n <= ends[of[start]]
            start, acc = start[fits], acc[fits] * self.STEP + hashes[start[fits] + n - 1]
            if not len(start):
                break
            if n not in self.lengths:
                continue
            hit = np.flatnonzero(np.isin(acc, self.lengths[n]))
            _, once = np.unique(np.column_stack([of[start[hit]].astype(U), acc[hit]]), axis=0, return_index=True)
            for i in hit[once].tolist():
                doc = int(of[start[i]])
                begin = int(ends[doc - 1]) if doc else 0
                out += [(doc, int(start[i]) - begin, p) for p in self.owners[n, int(acc[i])]]
        return out


def _passages(idf: np.ndarray, reach: Reach, phrases: Phrases, window: int, stride: int, lead: int) -> Callable:
    """Texts to the passages that may reach a piece, by group: benchmark terms by place, length as a vector.

    A phrase found is a row of group -1 with its number in ``phrase``.
    """
    place = reach.place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_column(pc.utf8_lower(batch.column(3)))
            for first, last in blocks(offsets):
                at = offsets[first : last + 1] - offsets[first]
                _, _, hashes, of = words(data[offsets[first] : offsets[last]], at)
                slot, pair = bucket(hashes), np.append(pair_bucket(hashes), 0)[: len(hashes)]
                every, ours = _masses(slot, idf, place)
                pairs, our_pairs = _masses(pair[:-1], idf, place)
                count = np.bincount(of, minlength=last - first)
                begin = np.cumsum(count) - count
                hits = phrases.found(hashes, of, slot, pair, begin + count)
                if hits:
                    doc, start, phrase = (np.array(x) for x in zip(*hits, strict=True))
                    none = np.zeros(len(doc), dtype=np.int64)
                    yield _found(batch, first + doc, start, none - 1, phrase, none.astype(float),
                                 *(_lists(np.empty(0, t), none, none) for t in (np.int32, np.int64)))
                n = np.where(count > 0, -(-np.maximum(count - window, 0) // stride) + 1, 0)
                doc = np.repeat(np.arange(last - first), n)
                turn = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                low = begin[doc] + turn * stride
                high = np.minimum(low + window, begin[doc] + count[doc])
                end = np.maximum(high - 1, low)
                near = ours[high] - ours[low] + our_pairs[end] - our_pairs[low]
                whole = every[high] - every[low] + pairs[end] - pairs[low]
                keep = np.flatnonzero(near >= reach.gate * whole)
                if not len(keep) or not reach.pieces:
                    continue
                both = np.concatenate([place[slot], place[pair]])
                # Rounding of the running sums must not part a passage from a piece it just reaches.
                values, ends = _terms(both, *_spans(low[keep], high[keep], end[keep], len(slot)))
                row, group = reach.groups(values, ends, whole[keep] * (1 - 1e-9))
                if not len(row):
                    continue
                keep = keep[row]
                doc, low, high, end = doc[keep], low[keep], high[keep], end[keep]
                left = np.maximum(low - lead, begin[doc])
                right = np.minimum(high + lead, begin[doc] + count[doc])
                values, ends = _terms(both, *_spans(low, high, end, len(slot)))
                terms = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                yield _found(batch, first + doc, low - begin[doc], group, np.full(len(doc), -1),
                             np.sqrt(whole[keep]), terms, _lists(hashes.view(np.int64), left, right))

    return run


def _spans(low: np.ndarray, high: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each passage the range of its words and, ``n`` further, that of its pairs."""
    return np.column_stack([low, low + n]).ravel(), np.column_stack([high, end + n]).ravel()


def _found(batch, rows, start, group, phrase, norm, terms, around) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            *(batch.column(i).take(pa.array(rows)) for i in range(3)),
            pa.array(start.astype(np.int32)),
            terms,
            pa.array(norm),
            around,
            pa.array(group.astype(np.int32)),
            pa.array(phrase.astype(np.int32)),
        ],
        names=["k1", "k2", "id", "start", "terms", "norm", "around", "group", "phrase"],
    )


def _masses(slots: np.ndarray, idf: np.ndarray, place: np.ndarray):
    """Running sums of the squared weights of all terms and of the benchmark's."""
    mass = idf[slots].astype(np.float64) ** 2
    ours = np.where(place[slots] >= 0, mass, 0.0)
    return np.append(0.0, np.cumsum(mass)), np.append(0.0, np.cumsum(ours))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and where each range begins and ends."""
    size = high - low
    ends = np.append(0, np.cumsum(size))
    return np.arange(ends[-1]) + np.repeat(low - ends[:-1], size), ends


def _lists(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.ListArray:
    at, ends = _ranges(low, high)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[at]))


def _terms(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places that are not -1 of two ranges each (words and pairs), and their offsets."""
    at, ends = _ranges(low, high)
    found = places[at]
    inside = found >= 0
    return found[inside], np.append(0, np.cumsum(inside))[ends[::2]]


@dataclass
class Rows:
    """TF-IDF rows: terms by place, terms per row, length of each row as a vector."""

    terms: np.ndarray
    size: np.ndarray
    norm: np.ndarray

    def entries(self, weight: np.ndarray):
        """Distinct (row, term), in order of rows, with the values of unit rows."""
        n = len(weight)
        row = np.repeat(np.arange(len(self.size)), self.size)
        pair, tf = np.unique(row * n + self.terms, return_counts=True)
        row, term = pair // n, pair % n
        return row, term, tf * weight[term] / self.norm[row]


def project(rows: Rows, weight: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Rows times ``matrix``, which has a line per term."""
    row, term, value = rows.entries(weight)
    out = np.zeros((len(rows.size), matrix.shape[1]))
    full, begin = np.unique(row, return_index=True)
    if len(full):
        out[full] = np.add.reduceat(matrix[term] * value[:, None], begin, axis=0)
    return out


def back(rows: Rows, weight: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Transposed rows times ``left`` (one line per row)."""
    row, term, value = rows.entries(weight)
    part = left[row] * value[:, None]
    columns = [np.bincount(term, part[:, c], len(weight)) for c in range(left.shape[1])]
    return np.column_stack(columns)


def _rows(batch: pa.RecordBatch, inner: np.ndarray, terms: int, norm: int):
    """(first row, Rows) of the batch, with the terms that ``inner`` gives a place in the group."""
    for first in range(0, batch.num_rows, 2048):
        part = batch.slice(first, 2048)
        ends = part.column(terms).offsets.to_numpy()
        values = inner[part.column(terms).values.to_numpy()[ends[0] : ends[-1]]]
        kept = values >= 0
        size = np.diff(np.append(0, np.cumsum(kept))[ends - ends[0]])
        yield first, Rows(values[kept].astype(np.int64), size, part.column(norm).to_numpy())


def _product(weight: np.ndarray, inner: np.ndarray, matrix: np.ndarray, gram: bool) -> Callable:
    """Partition sums of A'A M, or, if ``gram``, of (A M)'(A M)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rank = matrix.shape
        total = np.zeros((rank if gram else n, rank))
        for batch in batches:
            for _, rows in _rows(batch, inner, 0, 1):
                left = project(rows, weight, matrix)
                total += left.T @ left if gram else back(rows, weight, left)
        yield _part(total.ravel())

    return run


def latent_space(
    passages: DataFrame,
    own: Rows,
    weight: np.ndarray,
    inner: np.ndarray,
    rank: int,
    heavy: float,
    seed: int,
) -> np.ndarray:
    """Leading right singular vectors of the passages' rows and ``heavy`` times the ``own`` rows."""
    n = len(weight)
    rank = min(rank, n)
    rows = passages.select("terms", "norm").coalesce(
        max(8, shuffle_width(passages.sparkSession) // 4)
    )

    def product(matrix: np.ndarray, gram: bool = False) -> np.ndarray:
        shape = (rank, rank) if gram else (n, rank)
        matrix = matrix.astype(np.float32)
        parts = rows.mapInArrow(_product(weight, inner, matrix, gram), "part binary")
        left = project(own, weight, matrix)
        ours = left.T @ left if gram else back(own, weight, left)
        return sum_arrays(parts, shape[0] * shape[1]).reshape(shape) + heavy * ours

    basis = np.random.default_rng(seed).standard_normal((n, rank))
    for _ in range(2):
        basis = np.linalg.qr(product(basis))[0]
    strength, turn = np.linalg.eigh(product(basis, gram=True))
    return (basis @ turn[:, strength > 1e-9 * max(strength.max(), 1e-300)]).astype(np.float32)


def common_share(piece: np.ndarray, text: np.ndarray, weight: np.ndarray) -> float:
    """Share of the piece's weight in its heaviest common subsequence with the text."""
    best = np.zeros(len(text) + 1)
    for word, heavy in zip(piece, weight, strict=True):
        taken = np.where(text == word, best[:-1] + heavy, best[1:])
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], taken))
    return float(best[-1] / weight.sum())


def _search(weight, inner, space, pieces: Pieces, latent, items, cosine, exact, loose, found) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(6)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(U)
            rows, hits = [], []
            for first, part in _rows(batch, inner, 4, 5):
                alike = project(part, weight, space) @ latent.T
                for i, j in zip(*np.nonzero(alike >= cosine), strict=True):
                    around = values[ends[first + i] : ends[first + i + 1]]
                    # Words that occur at all bound the subsequence from above.
                    weighs = pieces.weight[j]
                    if weighs[np.isin(pieces.hashes[j], around)].sum() < loose * weighs.sum():
                        continue
                    cover = common_share(pieces.hashes[j], around, weighs)
                    if cover < loose:
                        continue
                    told = common_share(pieces.answer[j], around, pieces.answer_weight[j])
                    if cover >= exact or told >= found:
                        rows.append(first + i)
                        hits.append((items[pieces.owner[j]], cover, told, float(alike[i, j])))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(rows)) for c in range(4)),
                        *(pa.array(list(x)) for x in zip(*hits, strict=True)),
                    ],
                    names=["k1", "k2", "id", "start", "item", "cover", "told", "cosine"],
                )

    return run


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 32,
    stride: int = 16,
    piece: int = 64,
    min_words: int = 8,
    answer_words: int = 8,
    rank: int = 64,
    gate: float | None = None,
    cosine: float = 0.35,
    exact: float = 0.6,
    loose: float = 0.5,
    found: float = 0.75,
    block_items: int = 10_000,
    block_chars: int = 1 << 24,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, k1, k2, item, cover, told, cosine, start): one row per document and text it leaks.

    Ids of documents and of benchmark texts may be of any type that has a text form.
    """
    gate = cosine if gate is None else min(gate, cosine)
    spark = docs.sparkSession
    kind, item_kind = (t.schema[c].dataType for t, c in ((docs, id_col), (benchmark, item_col)))
    schema = (
        f"k1 long, k2 long, id {kind.simpleString()}, start int, item string, cover double,"
        " told double, cosine double"
    )
    keyed = docs.select(
        *document_keys(F.col(id_col), F.col(text_col), kind),
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
    )
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")
    ).where("item is not null and text is not null")
    number, chars = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_blocks = max(-(-number // block_items), -(-chars // block_chars))
    idf = rarity(docs, text_col, window, stride) if n_blocks else None
    path = scratch_dir(spark, "leaks")
    # Every search adds its hits to one table, so that the plan does not grow with the benchmark.
    spark.createDataFrame([], schema).write.parquet(path)
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block)
        chosen = sorted((r["item"], r["text"]) for r in part.collect())
        if not chosen:
            continue
        names, texts = zip(*chosen, strict=True)
        pieces = cut_pieces(texts, idf, piece, min_words, answer_words)
        terms = [np.append(bucket(h), pair_bucket(h)) for h in pieces.hashes]
        reach = Reach(terms, idf, gate, rank)
        passages = keyed.mapInArrow(
            _passages(idf, reach, Phrases(texts, window), window, stride, piece),
            f"k1 long, k2 long, id {kind.simpleString()}, start int, terms array<int>,"
            " norm double, around array<long>, group int, phrase int",
        )
        # Sorted by group, so that the passes over one group skip the pages of the others.
        passages = cut_lineage(passages.sortWithinPartitions("group"))
        phrases = passages.where("group = -1").select(
            "k1", "k2", "id", "start", "phrase", *[F.lit(1.0).alias(c) for c in ("cover", "told", "cosine")]
        )
        found_here = [phrases.mapInArrow(_with_names(names), schema)]
        sizes = {r["group"]: r["count"] for r in passages.groupBy("group").count().collect()}
        for begin in range(0, len(terms), rank):
            near = passages.where(F.col("group") == begin // rank)
            size = sizes.get(begin // rank, 0)
            if not size:
                continue
            group = terms[begin : begin + rank]
            ours = np.unique(np.concatenate(group))
            # places in the group's vocabulary of the places in the block's
            inner = np.full(len(reach.slots), -1, dtype=np.int32)
            inner[reach.place[ours]] = np.arange(len(ours))
            weight = idf[ours].astype(np.float64)
            own = Rows(
                inner[reach.place[np.concatenate(group)]].astype(np.int64),
                np.array([len(t) for t in group]),
                np.array([np.sqrt((idf[t].astype(np.float64) ** 2).sum()) for t in group]),
            )
            space = latent_space(near, own, weight, inner, rank, float(size), seed)
            latent = project(own, weight, space)
            latent /= np.maximum(np.sqrt((latent * latent).sum(axis=1)), 1e-12)[:, None]
            some = Pieces(*(x[begin : begin + rank] for x in vars(pieces).values()))
            search = _search(weight, inner, space, some, latent, names, cosine, exact, loose, found)
            found_here.append(near.mapInArrow(search, schema))
            if len(found_here) == 8:
                reduce(DataFrame.union, found_here).write.mode("append").parquet(path)
                found_here = []
        if found_here:
            reduce(DataFrame.union, found_here).write.mode("append").parquet(path)
    return _named(spark.read.schema(schema).parquet(path), id_col, item_kind)


def _with_names(names: tuple[str, ...]) -> Callable:
    """Rows with the number of a benchmark text to rows with its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = pa.array([names[i] for i in batch.column(4).to_pylist()], pa.string())
            columns = [item if i == 4 else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(
                columns, names=["k1", "k2", "id", "start", "item", "cover", "told", "cosine"]
            )

    return run


def _named(hits: DataFrame, id_col: str, item_kind: DataType) -> DataFrame:
    return (
        hits.withColumn("item", F.col("item").cast(item_kind))
        .groupBy("k1", "k2", "id", "item")
        .agg(
            F.max("cover").alias("cover"),
            F.max("told").alias("told"),
            F.max("cosine").alias("cosine"),
            F.min("start").alias("start"),
        )
        .withColumnRenamed("id", id_col)
    )
