"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered through ``threshold`` bytes only: two suffixes in one group at that depth start
the same window of ``threshold`` bytes, and a group of two or more is a repeated window. The passes
go from the most significant digit down, and a suffix that is alone in its group leaves:

1. The first digit of a window is its anchor: the place of the smallest hash among its substrings of
   ``gram`` bytes, a function of the window alone, so equal windows have equal digits. All windows
   of a document with one anchor stand next to each other; such a run is one row until its
   group splits. Rows carry the digit and a digest of the whole run.
2. A run whose group is one string is decided as a whole. Of the other groups each different string
   sends one run on, cut into steps of ``STEP`` windows at fixed distances from the
   anchor. The second digit is the substring that all windows of a step share.
3. Steps whose group is one string are decided as a whole; the others are ordered window by window
   through the full depth.

Digests are 64 bits, always compared together with the digest of the digit before, so two different
windows count as equal with a probability of about 2 ** -128 per pair that shares nothing.

Groups are only ever counted (partial sums before each shuffle) and joined back by key, where adaptive
execution splits a hot key; nothing gathers a group. Per document, spans are gathered, which its length bounds.

``passage`` asks for the same over words `[^\\x20\\x09-\\x0D]+`, whatever blanks stand between them:
``n_shared_words`` counts the words of strings of ``passage`` words that another row has too. A passage shorter than
``threshold`` bytes is seen there only; it is counted, not removed. Digits are the anchor, then the
run, then the window (there are fewer words than bytes, so no steps), and rows are counted, not places.

Defined results: a null text is the empty text; texts shorter than the threshold lose nothing;
equal rows are repeats of each other; null ids are kept; an empty table gives an empty table; other
columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.common import cut_lineage, document_keys, ship, shuffle_width
from martwright.llm.periodic import spaced_words
from martwright.llm.textarrays import U, Rolling, blocks, mix, sliding, text_column

ship(__name__)
STEP = 16
_PLACE = U((1 << 31) - 1)


def anchored(rolling: Rolling, start: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of the windows at ``start`` with one anchor: first and last start, anchor, digit and digest."""
    grams = rolling.windows(gram)
    tagged = (grams & ~_PLACE) | np.arange(len(grams), dtype=U)
    best = sliding(np.minimum, tagged, width - gram + 1)
    anchor = (best[start] & _PLACE).astype(np.int64)
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(fresh)
    low = start[head]
    high = start[np.append(head[1:], len(start)) - 1]
    anchor = anchor[head]
    return low, high, anchor, grams[anchor], rolling.of(low, high + width)


def _anchors(threshold: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = text_column(batch.column(2))
            for first, last in blocks(offsets):
                at = offsets[first : last + 1] - offsets[first]
                block = data[offsets[first] : offsets[last]]
                if len(block) < threshold:
                    continue
                n = len(block) - threshold + 1
                doc = np.repeat(np.arange(last - first), np.diff(at))[:n]
                start = np.flatnonzero(at[doc + 1] - np.arange(n) >= threshold)
                if not len(start):
                    continue
                low, high, anchor, digit, string = anchored(Rolling(block), start, threshold, gram)
                of = doc[low]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digit.view(np.int64)),
                        pa.array(string.view(np.int64)),
                        pa.array(k1[first:last][of]),
                        pa.array(k2[first:last][of]),
                        pa.array((low - at[of]).astype(np.int32)),
                        pa.array((high - low + 1).astype(np.int32)),
                        pa.array((anchor - low).astype(np.int32)),
                    ],
                    names=["digit", "run", "k1", "k2", "low", "n", "ahead"],
                )

    return run


_ANCHORS = "digit long, run long, k1 long, k2 long, low int, n int, ahead int"


def _steps(threshold: int):
    """Rows (k1, k2, text, runs) to steps of their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = text_column(batch.column(2))
            lists = batch.column(3)
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values
            low, n, ahead = (flat.field(f).to_numpy() for f in ("low", "n", "ahead"))
            alone = flat.field("alone").to_numpy(zero_copy_only=False)
            for first, last in blocks(offsets):
                at = offsets[first : last + 1] - offsets[first]
                rolling = Rolling(data[offsets[first] : offsets[last]])
                part = slice(ends[first], ends[last])
                of = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
                runs = n[part].astype(np.int64)
                row = np.repeat(np.arange(len(of)), runs)
                inner = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
                start = (at[of] + low[part])[row] + inner
                distance = ahead[part][row] - inner
                step = distance // STEP
                head = np.flatnonzero(
                    np.append(True, (row[1:] != row[:-1]) | (step[1:] != step[:-1]))
                    if len(row)
                    else np.empty(0, bool)
                )
                if not len(head):
                    continue
                size = np.diff(np.append(head, len(row)))
                begin, of_row = start[head], row[head]
                anchor = begin + distance[head]
                core = anchor - STEP * step[head]
                digit = rolling.of(core, core - STEP + 1 + threshold)
                digit = mix(digit + step[head].astype(U))
                whole = mix(rolling.of(begin, begin + size + threshold - 1) + distance[head].astype(U))
                doc = of[of_row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digit.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        pa.array(k1[first:last][doc]),
                        pa.array(k2[first:last][doc]),
                        pa.array((begin - at[doc]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array(alone[part][of_row]),
                    ],
                    names=["digit", "run", "k1", "k2", "low", "n", "alone"],
                )

    return run


_STEPS = "digit long, run long, k1 long, k2 long, low int, n int, alone boolean"


def _first(docs: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Whether no place before has the digest in the same document."""
    order = np.lexsort((digests, docs))
    again = (docs[order][1:] == docs[order][:-1]) & (digests[order][1:] == digests[order][:-1])
    out = np.ones(len(docs), dtype=bool)
    out[order[1:][again]] = False
    return out


def _word_anchors(passage: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = text_column(batch.column(2))
            for first, last in blocks(offsets):
                at = offsets[first : last + 1] - offsets[first]
                _, _, hashes, doc = spaced_words(data[offsets[first] : offsets[last]], at)
                if len(hashes) < passage:
                    continue
                start = np.flatnonzero(doc[: len(doc) - passage + 1] == doc[passage - 1 :])
                if not len(start):
                    continue
                low, high, _, digit, string = anchored(Rolling(hashes), start, passage, gram)
                of = doc[low]
                # in periodic text equal runs stand next to each other: one row for all of them
                head = np.ones(len(low), dtype=bool)
                head[1:] = (string[1:] != string[:-1]) | (digit[1:] != digit[:-1])
                head[1:] |= (low[1:] != high[:-1] + 1) | (of[1:] != of[:-1])
                high = high[np.append(head[1:], True)]
                low, digit, string, of = low[head], digit[head], string[head], of[head]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digit.view(np.int64)),
                        pa.array(string.view(np.int64)),
                        pa.array(k1[first:last][of]),
                        pa.array(k2[first:last][of]),
                        pa.array((low - np.searchsorted(doc, of)).astype(np.int32)),
                        pa.array((high - low + 1).astype(np.int32)),
                        pa.array(_first(of, digit)),
                        pa.array(_first(of, string)),
                    ],
                    names=["digit", "run", "k1", "k2", "low", "n", "new_digit", "new_run"],
                )

    return run


_WORD_ANCHORS = (
    "digit long, run long, k1 long, k2 long, low int, n int, new_digit boolean, new_run boolean"
)


def _windows(width: int, by_word: bool):
    """Rows (k1, k2, text, runs) to the windows of their runs.

    The weight says how many places, by word how many rows, a window stands for: 2 for a string that
    several rows have, 0 for a window met before in its document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            data, offsets = text_column(batch.column(2))
            lists = batch.column(3)
            ends = lists.offsets.to_numpy().astype(np.int64)
            digit, low, n = (lists.values.field(f).to_numpy() for f in ("digit", "low", "n"))
            alone = lists.values.field("alone").to_numpy(zero_copy_only=False)
            for first, last in blocks(offsets):
                at = offsets[first : last + 1] - offsets[first]
                symbols = data[offsets[first] : offsets[last]]
                if by_word:
                    _, _, symbols, doc = spaced_words(symbols, at)
                    at = np.searchsorted(doc, np.arange(last - first))
                part = slice(ends[first], ends[last])
                of = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
                runs = n[part].astype(np.int64)
                row = np.repeat(np.arange(len(of)), runs)
                if not len(row):
                    continue
                place = low[part][row] + np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
                of = of[row]
                start = at[of] + place
                windows = Rolling(symbols).of(start, start + width)
                own = alone[part][row]
                weight = np.where(own, _first(of, windows), 2) if by_word else np.ones(len(row))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digit[part][row]),
                        pa.array(windows.view(np.int64)),
                        pa.array(k1[first:last][of]),
                        pa.array(k2[first:last][of]),
                        pa.array(place.astype(np.int32)),
                        pa.array(own),
                        pa.array(weight.astype(np.int32)),
                    ],
                    names=["digit", "window", "k1", "k2", "place", "alone", "weight"],
                )

    return run


_WINDOWS = "digit long, window long, k1 long, k2 long, place int, alone boolean, weight int"


def window_by_window(spread: DataFrame, places: DataFrame, width: int, by_word: bool) -> DataFrame:
    """Starts (k1, k2, b, e) of the windows that others have too, of ``places`` that are alone.

    The windows are read off the texts ``spread`` (k1, k2, id, text), so no shuffle carries windows
    whose digit is not wanted.
    """
    split = places.groupBy("k1", "k2").agg(
        F.collect_set(F.struct("digit", "low", "n", "alone")).alias("runs")
    )
    windows = (
        spread.join(split, ["k1", "k2"])
        .select("k1", "k2", "text", "runs", "id")
        .mapInArrow(_windows(width, by_word), _WINDOWS)
    )
    common = (
        windows.where("weight > 0")
        .groupBy("digit", "window")
        .agg(F.sum("weight").alias("weight"))
        .where("weight > 1")
        .select("digit", "window")
    )
    return (
        windows.where("alone")
        .join(common, ["digit", "window"], "left_semi")
        .select("k1", "k2", F.col("place").alias("b"), (F.col("place") + 1).alias("e"))
    )


def _apply(with_kept: bool):
    """Rows (id, text, spans, note) to their results; spans may overlap, the note is handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_column(batch.column(1))
            lists = batch.column(2)
            have = np.asarray(lists.is_valid())
            ends = lists.offsets.to_numpy().astype(np.int64)
            begin, end = (lists.values.field(f).to_numpy() for f in ("b", "e"))
            removed, digests, kept, spans = [], [], [], []
            raw = data.tobytes()
            for i in range(batch.num_rows):
                a, b = int(offsets[i]), int(offsets[i + 1])
                pairs, pieces, last = [], [], 0
                if have[i] and ends[i] < ends[i + 1]:
                    part = slice(ends[i], ends[i + 1])
                    order = np.argsort(begin[part], kind="stable")
                    s, e = begin[part][order], np.maximum.accumulate(end[part][order])
                    head = np.append(True, s[1:] > e[:-1])
                    tail = np.append(head[1:], True)
                    pairs = list(zip(s[head].tolist(), e[tail].tolist(), strict=True))
                for s, e in pairs:
                    pieces.append(raw[a + last : a + s])
                    last = e
                pieces.append(raw[a + last : b])
                rest = b"".join(pieces)
                removed.append(b - a - len(rest))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_kept else None)
                spans.append([{"b": s, "e": e} for s, e in pairs])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets)),
                    pa.array(removed, pa.int64()),
                    pa.array([len(x) for x in spans], pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("b", pa.int32()), ("e", pa.int32())]))),
                    pa.array(kept, pa.binary()),
                    batch.column(3),
                ],
                names=[
                    *("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"),
                    "note",
                ],
            )

    return run


def cut_spans(
    keyed: DataFrame, lists: DataFrame, id_col: str, with_kept: bool, note: str | None = None
) -> DataFrame:
    """Remove spans (k1, k2, spans, note) from documents (k1, k2, id, text).

    Bytes are counted from 0, the end ``e`` of a span is the first byte after it.
    ``note`` names a long column of ``lists`` to hand on, 0 where a document has no spans.
    """
    kind = keyed.schema["id"].dataType.simpleString()
    lists = lists.withColumn("note", F.col(note) if note else F.lit(0).cast("long"))
    schema = (
        f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string,"
        " spans array<struct<b:int,e:int>>, kept binary, note long"
    )
    out = (
        keyed.join(lists.select("k1", "k2", "spans", "note"), ["k1", "k2"], "left")
        .select("id", "text", "spans", F.coalesce("note", F.lit(0)).cast("long").alias("note"))
        .mapInArrow(_apply(with_kept), schema)
        .withColumnRenamed("id", id_col)
    )
    out = out if with_kept else out.drop("kept")
    return out.withColumnRenamed("note", note) if note else out.drop("note")


def repeats(rows: DataFrame) -> DataFrame:
    """Per digit of ``rows`` that more than one row has: whether all its rows are one string."""
    return (
        rows.groupBy("digit")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("run").alias("a"), F.max("run").alias("b"))
        .where("rows > 1")
        .select("digit", (F.col("a") == F.col("b")).alias("one"))
    )


def shared_words(keyed: DataFrame, spread: DataFrame, passage: int) -> DataFrame:
    """Stretches (k1, k2, b, e) of words, from 0, whose strings of ``passage`` words another row has too.

    Stretches may overlap. ``spread`` has the rows (k1, k2, id, text) of ``keyed``, dealt by key.
    """
    runs = keyed.select("k1", "k2", "text").mapInArrow(
        _word_anchors(passage, passage // 4), _WORD_ANCHORS
    )
    met = runs.where("new_digit").groupBy("digit").count().where("count > 1").select("digit")
    again = cut_lineage(runs.drop("new_digit").join(cut_lineage(met), "digit"))
    strings = cut_lineage(
        again.groupBy("digit", "run").agg(
            F.count_if("new_run").alias("rows"), F.min(F.struct("k2", "k1", "low", "n")).alias("of")
        )
    )
    decided = again.join(
        strings.where("rows > 1").select("digit", "run"), ["digit", "run"], "left_semi"
    ).select("k1", "k2", F.col("low").alias("b"), (F.col("low") + F.col("n")).alias("e"))

    # Strings of one row can share windows with others of their digit: one place of those
    # that several rows have, all places of those that must still be decided.
    mixed = strings.groupBy("digit").count().where("count > 1").select("digit")
    other = strings.join(mixed, "digit", "left_semi")
    place = ["k1", "k2", "digit", "low", "n"]
    once = other.where("rows = 1").select("digit", "run")
    places = (
        other.where("rows > 1")
        .select("digit", "of.*")
        .select(*place, F.lit(False).alias("alone"))
        .union(
            again.join(once, ["digit", "run"], "left_semi").select(*place, F.lit(True).alias("alone"))
        )
    )
    found = window_by_window(spread, places, passage, by_word=True)
    return decided.union(found).withColumn("e", F.col("e") + (passage - 1))


def covered(spans: Column) -> Column:
    """How many places an array of spans (b, e) covers."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, x: Column) -> Column:
        more = F.greatest(x.e - F.greatest(acc.end, x.b), F.lit(0))
        return F.struct(F.greatest(acc.end, x.e).alias("end"), (acc.n + more).alias("n"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc.n)


def remove_repeats(
    docs: DataFrame,
    *,
    threshold: int = 400,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_kept: bool = True,
    passage: int | None = None,
) -> DataFrame:
    """Remove each byte covered by a string of ``threshold`` bytes that starts anywhere else too.

    One row per row: id, n_bytes, n_removed, n_spans, kept_sha256, spans and, if wanted, the kept bytes.
    With ``passage`` also n_shared_words, the words in strings of so many words that another row has too.
    """
    keyed = docs.select(
        *document_keys(F.col(id_col), F.col(text_col), docs.schema[id_col].dataType),
        F.col(id_col).alias("id"),
        F.col(text_col).alias("text"),
    )
    runs = keyed.select("k1", "k2", "text").mapInArrow(
        _anchors(threshold, threshold // 2), _ANCHORS
    )
    # Written first, so that the joins read plain shuffles on both sides and a hot digit is split.
    again = cut_lineage(runs.join(cut_lineage(repeats(runs)), "digit"))
    strings = cut_lineage(
        again.groupBy("digit", "run").agg(
            F.count(F.lit(1)).alias("copies"),
            F.first("one").alias("one"),
            F.min(F.struct("k2", "k1", "low", "n", "ahead")).alias("of"),
        )
    )
    decided = again.join(
        strings.where("copies > 1").select("digit", "run"), ["digit", "run"], "left_semi"
    ).select("k1", "k2", F.col("low").alias("b"), (F.col("low") + F.col("n")).alias("e"))

    # The one shuffle of the texts; both joins below read it.
    spread = keyed.repartition(shuffle_width(docs.sparkSession), "k1", "k2")
    split = (
        strings.where("not one")
        .select("of.*", (F.col("copies") == 1).alias("alone"))
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("low", "n", "ahead", "alone")).alias("runs"))
    )
    steps = (
        spread.join(split, ["k1", "k2"])
        .select("k1", "k2", "text", "runs", "id")
        .mapInArrow(_steps(threshold), _STEPS)
    )
    met = steps.join(repeats(steps), "digit")
    whole = met.where("one and alone").select(
        "k1", "k2", F.col("low").alias("b"), (F.col("low") + F.col("n")).alias("e")
    )
    places = met.where("not one").select("k1", "k2", "digit", "low", "n", "alone")
    found = window_by_window(spread, places, threshold, by_word=False)
    starts = decided.union(whole).union(found)
    end = (F.col("e") + (threshold - 1)).alias("e")
    if passage is None:
        spans = starts.groupBy("k1", "k2").agg(F.collect_list(F.struct("b", end)).alias("spans"))
        return cut_spans(spread, spans, id_col, with_kept)
    stretches = shared_words(keyed, spread, passage)
    lists = (
        starts.select("k1", "k2", F.struct("b", end).alias("span"))
        .unionByName(
            stretches.select("k1", "k2", F.struct("b", "e").alias("words")), allowMissingColumns=True
        )
        .groupBy("k1", "k2")
        .agg(F.collect_list("span").alias("spans"), F.collect_set("words").alias("words"))
        .withColumn("n_shared_words", covered(F.col("words")))
    )
    return cut_spans(spread, lists, id_col, with_kept, note="n_shared_words")
