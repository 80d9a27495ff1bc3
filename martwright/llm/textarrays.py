"""Whole Arrow batches of text as byte arrays, and rolling hashes over them.

Used inside ``mapInArrow``: a batch is cut into blocks of whole documents of about a
megabyte, and each block is worked on as one array, so memory follows the block or the longest
document, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from martwright.llm.common import ship

ship(__name__)
U = np.uint64
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit; the input stays."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def random_table(seed: int, n: int = 256) -> np.ndarray:
    """Odd pseudo-random numbers."""
    counts = np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)
    return mix(counts) | U(1)


BYTES = (random_table(1), random_table(7920))
class _Cache(dict):
    """Kept where it is filled: functions sent to the executors take an empty one along."""

    def __reduce__(self):
        return _Cache, ()


_POWERS = _Cache()


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096)
        have = np.full(size, base, dtype=U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * BLOCK:
            _POWERS[base] = have
    return have[:n]


BASES = (0x9E3779B97F4A7C55, 0xD1342543DE82EF95)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


class Rolling:
    """Hashes of any substring of a byte block, or of an array of 64-bit digests, from one running sum."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.sums = np.empty(len(data) + 1, dtype=U)
        self.sums[0] = 0
        symbols = data if data.dtype == U else BYTES[which][data]
        np.cumsum(symbols * powers(BASES[which], len(data)), out=self.sums[1:])
        self.back = powers(INVERSES[which], len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the substrings [start, end), spread and with their length mixed in."""
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(U) * U(0xA0761D6478BD642F))

    def windows(self, width: int) -> np.ndarray:
        """Of every window of ``width`` bytes."""
        n = len(self.sums) - width
        raw = (self.sums[width:] - self.sums[:n]) * self.back[:n]
        return mix(raw + U((width * 0xA0761D6478BD642F) & (2**64 - 1)))


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1]
    at = at.astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of documents of about ``size`` bytes each, one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def sliding(op: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``np.minimum`` or ``np.maximum`` of every window of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


_KIND = np.zeros(256, dtype=bool)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, hashes and documents of all words of a block.

    Words are runs of digits, ASCII letters (case folded) and bytes beyond ASCII; they
    end with their document. ``offsets`` are relative to ``data``.
    """
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = _KIND[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:])
    begin, finish = edge & inside, edge & ~inside
    cuts = offsets[1:-1]
    if len(cuts):
        # a word that runs over the end of a document is two words
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
        cuts = cuts[inside[cuts] & inside[cuts - 1]]
        begin[cuts] = True
        finish[cuts] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish)
    hashes = Rolling(_FOLD[data]).of(starts, ends)
    return starts, ends, hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingles(hashes: np.ndarray, docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of all runs of ``width`` words within one document.

    A document with fewer words, but any, has one shingle of all of them.
    """
    n = len(hashes) - width + 1
    out, of = np.empty(0, U), np.empty(0, docs.dtype)
    if n > 0:
        acc = np.zeros(n, dtype=U)
        for k in range(width):
            acc = acc * U(0x9FB21C651E98DF25) + hashes[k : k + n]
        fits = docs[:n] == docs[width - 1 :]
        out, of = mix(acc[fits]), docs[:n][fits]
    if len(docs):
        names, first, count = np.unique(docs, return_index=True, return_counts=True)
        short = np.flatnonzero(count < width)
        if len(short):
            own = np.empty(len(short), U)
            for i, j in enumerate(short):
                acc = U(count[j])
                for h in hashes[first[j] : first[j] + count[j]]:
                    acc = mix(np.array([acc], U))[0] ^ h
                own[i] = acc
            out = np.concatenate([out, mix(own)])
            of = np.concatenate([of, names[short]])
    return out, of
