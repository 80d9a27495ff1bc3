"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text (each step doubles the hash and adds the byte's random
number, so it forgets what lies 32 bytes back). A chunk ends where the hash is the largest within
``reach`` bytes to either side. That depends on the bytes near the place alone: after an insertion
the next chunks are the same again, and no two chunk ends are closer than ``reach``.

A repeated passage loses up to 32 + ``reach`` bytes and part of a chunk at its beginning and ``reach`` bytes
and part of a chunk at its end; with chunks of 33 bytes on average, passages of 50 words are found.

Chunks are compared by a digest of 128 bits. A repeated chunk counts if it stands in a run of neighbouring
repeated chunks of at least ``min_run`` bytes, so chance repeats of a few common words do no harm. Whole
documents, and whole lines with anything but white space, are compared by digests of their
own beside that and count whatever their length. Of all
occurrences the first, by id and place, stays; the others are removed.

Digests are counted before they are joined back (partial counts before the shuffle; adaptive
execution splits a hot digest in the join). Per document, chunks are gathered, which its length bounds.

Defined results: a null text is the empty text, without chunks; equal rows are repeats of each
other, and as they cannot be told apart all of them keep the first occurrence or none;
a null id stands as 0 in the order; an empty table gives an empty table; other columns of the
input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import cut_lineage, document_keys, ship
from martwright.llm.suffixes import cut_spans
from martwright.llm.textarrays import U, Rolling, blocks, random_table, sliding, text_column

ship(__name__)
GEAR = random_table(4057)
MEMORY = 32
# Kinds of pieces, and what keeps their digests apart.
CHUNK, LINE, WHOLE = 0, 1, 2
APART = np.array([0, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B], dtype=U)
BLANK = np.isin(np.arange(256), list(b" \t\n\r\v\f"))


def chunk_ends(data: np.ndarray, offsets: np.ndarray, reach: int) -> np.ndarray:
    """Ends of all chunks of a block of documents, in order; every non-empty document has one."""
    gear, have = GEAR[data], 1
    while have < MEMORY:
        gear[have:] = gear[have:] + (gear[:-have] << U(have))
        have *= 2
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(data)) - offsets[doc]
    gear = np.where(inner >= MEMORY - 1, gear | U(1), U(0))
    # documents apart, so that no place sees another document
    place = np.arange(len(data)) + (doc + 1) * reach
    apart = np.zeros(len(data) + (len(sizes) + 1) * reach, dtype=U)
    apart[place] = gear
    top = sliding(np.maximum, apart, reach)
    ends = (gear > top[place - reach]) & (gear >= top[place + 1])
    last = offsets[1:][sizes > 0] - 1
    ends[last] = True
    return np.flatnonzero(ends) + 1


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all lines that are not blank; lines end with their document."""
    newline = np.flatnonzero(data == 10)
    start = np.union1d(newline + 1, offsets[:-1])
    end = np.append(np.minimum(start[1:], len(data)), len(data))
    end = end - ((end > start) & (data[np.maximum(end, 1) - 1] == 10))
    seen = np.append(0, np.cumsum(~BLANK[data]))
    start = np.minimum(start, len(data))
    kept = seen[end] > seen[start]
    return start[kept], end[kept]


def _chunks(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = text_column(batch.column(2))
            for first, last in blocks(offsets):
                at = offsets[first : last + 1] - offsets[first]
                block = data[offsets[first] : offsets[last]]
                if not len(block):
                    continue
                end = chunk_ends(block, at, reach)
                start = np.append(0, end[:-1])
                lines = line_spans(block, at)
                full = np.flatnonzero(np.diff(at))
                kind = np.repeat([CHUNK, LINE, WHOLE], [len(end), len(lines[0]), len(full)])
                apart = APART[kind]
                start = np.concatenate([start, lines[0], at[full]])
                end = np.concatenate([end, lines[1], at[full + 1]])
                doc = np.searchsorted(at, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((Rolling(block, 0).of(start, end) ^ apart).view(np.int64)),
                        pa.array((Rolling(block, 1).of(start, end) ^ apart).view(np.int64)),
                        pa.array(k1[first:last][doc]),
                        pa.array(k2[first:last][doc]),
                        pa.array((start - at[doc]).astype(np.int32)),
                        pa.array((end - start).astype(np.int32)),
                        pa.array(kind.astype(np.int8)),
                    ],
                    names=["d1", "d2", "k1", "k2", "b", "n", "kind"],
                )

    return run


def _union(spans: np.ndarray) -> list[tuple[int, int]]:
    """Spans that cover the same places without overlap."""
    out, reach = [], 0
    for x, y in sorted(spans[:, :2].tolist()):
        if max(x, reach) < y:
            out.append((max(x, reach), y))
            reach = y
    return out


def _runs(min_run: int):
    """Rows (k1, k2, chunks) to (k1, k2, n_repeated, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, spans = [], []
            for chunks in batch.column(2):
                part = chunks.values
                kind = part.field("kind").to_numpy()
                order = np.lexsort((kind, part.field("b").to_numpy()))
                b = part.field("b").to_numpy()[order]
                e = b + part.field("n").to_numpy()[order]
                stays = part.field("stays").to_numpy(zero_copy_only=False)[order]
                kind = kind[order]
                # repeated rows list a piece twice
                new = np.append(True, (b[1:] != b[:-1]) | (kind[1:] != kind[:-1]))
                cut = new & (kind == CHUNK)
                counts = [np.column_stack([b, e, stays])[new & ~cut]]
                if cut.any():
                    b, e, stays = b[cut], e[cut], stays[cut]
                    run_of = np.cumsum(np.append(True, b[1:] != e[:-1])) - 1
                    long = (np.bincount(run_of, weights=e - b) >= min_run)[run_of]
                    counts.append(np.column_stack([b, e, stays])[long])
                counts = np.concatenate(counts).astype(np.int64)
                totals.append(sum(y - x for x, y in _union(counts)))
                spans.append([{"b": x, "e": y} for x, y in _union(counts[counts[:, 2] == 0])])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(totals, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))),
                ],
                names=["k1", "k2", "n_repeated", "spans"],
            )

    return run


def remove_repeated_chunks(
    docs: DataFrame,
    *,
    reach: int = 16,
    min_run: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_kept: bool = True,
) -> DataFrame:
    """One row per row: id, n_bytes, n_repeated, n_removed, n_spans, kept_sha256, spans, kept.

    ``n_repeated`` counts the bytes of long runs of repeated chunks, repeated lines and documents, first
    occurrences included.
    """
    keyed = docs.select(
        *document_keys(F.col(id_col), F.col(text_col), docs.schema[id_col].dataType),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
    )
    chunks = keyed.select("k1", "k2", "text").mapInArrow(
        _chunks(reach), "d1 long, d2 long, k1 long, k2 long, b int, n int, kind byte"
    )
    # Written first, so that the join reads plain shuffles on both sides and a hot digest is split.
    counts = cut_lineage(chunks.groupBy("d1", "d2").count().where("count > 1").drop("count"))
    again = cut_lineage(chunks.join(counts, ["d1", "d2"], "left_semi"))
    first = cut_lineage(
        again.groupBy("d1", "d2").agg(F.min(F.struct("k2", "k1", "b")).alias("first"))
    )
    stays = F.col("first") == F.struct("k2", "k1", "b")
    lists = (
        again.join(first, ["d1", "d2"])
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("b", "n", "kind", stays.alias("stays"))).alias("chunks"))
        .mapInArrow(
            _runs(min_run), "k1 long, k2 long, n_repeated long, spans array<struct<b:int,e:int>>"
        )
    )
    return cut_spans(keyed, lists, id_col, with_kept, note="n_repeated")
