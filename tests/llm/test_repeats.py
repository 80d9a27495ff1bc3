"""Suffix and chunk dedup against byte-by-byte versions."""

import hashlib
import re
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest

from martwright.llm import chunks, queries, suffixes
from martwright.llm.textarrays import BLOCK, blocks, sliding


def covered(texts, width):
    """Per text the mask of bytes in windows that start more than once."""
    starts = Counter()
    for b in texts:
        for i in range(len(b) - width + 1):
            starts[b[i : i + width]] += 1
    masks = []
    for b in texts:
        mask = [False] * len(b)
        reach = 0
        for i in range(len(b)):
            if i + width <= len(b) and starts[b[i : i + width]] > 1:
                reach = i + width
            mask[i] = i < reach
        masks.append(mask)
    return masks


def expected(pairs, masks):
    out = Counter()
    for (doc_id, b), mask in zip(pairs, masks, strict=True):
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        spans = sum(m and not (i and mask[i - 1]) for i, m in enumerate(mask))
        out[(doc_id, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("threshold", [40, 64, 100])
def test_suffixes_match_brute_force(spark, threshold):
    docs = cases.documents(spark)
    pairs = [(r[0], (r[1] or "").encode()) for r in cases.rows()]
    got = suffixes.remove_repeats(docs, threshold=threshold).collect()
    want = expected(pairs, covered([b for _, b in pairs], threshold))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[n] for n in names) for r in got) == want
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert sum(s.e - s.b for s in r.spans) == r.n_removed


def test_suffixes_random_near_periodic_texts(spark):
    draw = np.random.default_rng(3)
    texts = ["".join(draw.choice(list("ab"), draw.integers(0, 60))) * 3 for _ in range(40)]
    texts += [t[5:] + "z" + t[:50] for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    got = suffixes.remove_repeats(df, threshold=24).collect()
    masks = covered([t.encode() for t in texts], 24)
    assert {r.doc_id: r.n_removed for r in got} == {i: sum(m) for i, m in enumerate(masks)}


def shared(texts, size):
    """Per text the number of words in strings of ``size`` words that another text has too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    rows = defaultdict(set)
    for i, w in enumerate(split):
        for j in range(len(w) - size + 1):
            rows[tuple(w[j : j + size])].add(i)
    out = []
    for w in split:
        mask = [False] * len(w)
        for j in range(len(w) - size + 1):
            if len(rows[tuple(w[j : j + size])]) > 1:
                mask[j : j + size] = [True] * size
        out.append(sum(mask))
    return out


@pytest.mark.parametrize("size", [8, 51])
def test_shared_passages_match_brute_force(spark, size):
    draw = np.random.default_rng(4)
    texts = [r[1] for r in cases.rows() if r[0] != 10]
    # few different words: many near-periodic strings, shared in part and at several places
    texts += [" ".join(draw.choice(["a", "b", "c d"], draw.integers(0, 90))) for _ in range(60)]
    texts += [(t or "x")[7:] + " z\n" + (t or "x")[:200] for t in texts[:40]]
    line = cases.prose(70, 60)
    texts += [f"{line}\n{line}", cases.prose(71, 9) * 30, f"{cases.prose(72, 70)}\t \n" * 3]
    rows = [(None if i % 9 == 0 else i, t) for i, t in enumerate(texts)]
    rows += [rows[30], rows[30], rows[-2]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffixes.remove_repeats(df, threshold=400, passage=size).collect()
    want = shared([t for _, t in rows], size)
    assert any(want)
    pairs = zip(rows, want, strict=True)
    assert Counter((r.doc_id, r.n_bytes, r.n_shared_words) for r in got) == Counter(
        (d, len((t or "").encode()), n) for (d, t), n in pairs
    )


def test_passages_below_400_bytes_are_counted_by_the_query(spark, tmp_path):
    passages = [cases.prose(800 + i, 51 + i % 10) for i in range(6)]
    passages = [" ".join(w[:5] for w in p.split()) for p in passages]
    assert all(len(p) < 400 for p in passages)
    rows = []
    for i, p in enumerate(passages):
        for j in (0, 1):
            around = cases.prose(900 + 2 * i + j, 80), cases.prose(950 + 2 * i + j, 70)
            rows.append((10 * i + j, f"{around[0]}\n{p}{'  ' if j else ' '}{around[1]}"))
        rows.append((10 * i + 5, cases.prose(990 + i, 200)))
        rows.append((10 * i + 6, f"{cases.prose(980 + i, 60)} " * 2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.LLM["op1_suffixes"].build(spark, str(tmp_path)).collect()}
    assert list(got[0].asDict())[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for i, p in enumerate(passages):
        n = len(p.split())
        assert [got[10 * i + j].n_shared_words for j in (0, 1, 5, 6)] == [n, n, 0, 0]
        assert [got[10 * i + j].n_removed for j in (0, 1, 5)] == [0, 0, 0]


def test_empty_tables(spark):
    assert suffixes.remove_repeats(cases.none(spark), passage=51).count() == 0
    assert suffixes.remove_repeats(cases.none(spark)).count() == 0
    assert chunks.remove_repeated_chunks(cases.none(spark)).count() == 0


def chunked(b, reach):
    """Chunk ends by the definition, one byte at a time."""
    gear = [int(x) for x in chunks.GEAR]
    h = [0] * len(b)
    for i in range(31, len(b)):
        h[i] = (sum(gear[b[i - j]] << j for j in range(32)) % 2**64) | 1
    ends = []
    for i in range(len(b)):
        before, after = h[max(0, i - reach) : i], h[i + 1 : i + 1 + reach]
        top = h[i] > max(before, default=0) and h[i] >= max(after, default=0)
        if i == len(b) - 1 or top:
            ends.append(i + 1)
    return [(s, b[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)] if b else []


def test_chunks_match_brute_force(spark):
    rows = [r for r in cases.rows() if r[0] != 10]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    got = chunks.remove_repeated_chunks(docs, reach=16, min_run=60).collect()
    cut = [(r[0], chunked((r[1] or "").encode(), 16)) for r in rows]
    count = Counter(c for _, parts in cut for _, c in parts)
    first = {}
    for doc_id, parts in sorted(cut, key=lambda x: x[0] or 0):
        for place, c in parts:
            first.setdefault(c, (doc_id or 0, place))
    want = Counter()
    for doc_id, parts in cut:
        runs = defaultdict(list)
        run = 0
        for place, c in parts:
            run += count[c] == 1
            if count[c] > 1:
                runs[run].append((place, c))
        long = [r for r in runs.values() if sum(len(c) for _, c in r) >= 60]
        gone = {p for r in long for p, c in r if first[c] != (doc_id or 0, p)}
        kept = b"".join(c for p, c in parts if p not in gone)
        repeated = sum(len(c) for r in long for _, c in r)
        want[(doc_id, repeated, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_repeated, r.kept_sha256) for r in got) == want
    assert any(k[1] for k in want)


def test_short_copies_of_documents_and_lines(spark):
    texts = [cases.prose(200 + n, n)[:n] for n in range(1, 100)]
    texts = ["".join(c if c != " " else "x" for c in t) for t in texts]
    split = [f"{cases.prose(800 + i, 4)}\n\n{cases.prose(900 + i, 3)}\n" for i in range(40)]
    around = [f"{cases.prose(400 + i, 6)}\n{t}\r\n \n{cases.prose(600 + i, 6)}" for i, t in enumerate(texts[:40])]
    rows = list(enumerate([*texts, *split, *texts, *split, *around]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in chunks.remove_repeated_chunks(df).collect()}
    first, copies = len(texts) + len(split), 2 * (len(texts) + len(split))
    seen = set()
    for i, t in rows:
        left = bytes(got[i].kept).decode()
        if first <= i < copies:
            assert left == "", (i, t)
        else:
            lines = t.split("\n")
            assert left.split("\n") == ["" if x.strip() and x in seen else x for x in lines]
        seen |= set(t.split("\n"))
        assert got[i].n_bytes == len(t.encode())
    assert all(got[i].n_removed == got[i].n_bytes for i in range(first, copies))


def test_chunks_survive_an_insertion():
    text = cases.prose(5, 2000).encode()
    moved = text[:3000] + b"inserted" + text[3000:]

    def parts(b):
        data = np.frombuffer(b, np.uint8)
        ends = chunks.chunk_ends(data, np.array([0, len(b)]), 32)
        return [b[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    new = set(parts(moved)) - set(parts(text))
    assert len(new) <= 4


def test_helpers():
    values = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 8, 20):
        want = [min(values[i : i + width]) for i in range(51 - width)]
        assert sliding(np.minimum, values, width).tolist() == want
    offsets = np.array([0, 10, 10, 3 * BLOCK, 3 * BLOCK + 5])
    assert list(blocks(offsets)) == [(0, 2), (2, 3), (3, 4)]
