"""Vector codes, language profiles and periodic runs against plain versions of their definitions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import cases
import numpy as np
import pytest

from martwright.llm import activelloyd, periodic, rankprofiles
from martwright.llm.common import open_table
from martwright.llm.queries import LLM, held_out, learnable

ROOT = "/root/testdata/sf0.001"


# -- vector codes


def plain_lloyd(rows, parts, entries, rounds):
    """(codes, errors, books) of (id, vector) rows by whole scans with Python's integers."""
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    rows.sort(key=lambda r: r[0])
    width = len(rows[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            row = []
            for p, book in enumerate(books):
                far = [sum((x - y) ** 2 for x, y in zip(c[p], e, strict=True)) for e in book]
                row.append((min(far), far.index(min(far))))
            out.append(row)
        return out

    for _ in range(rounds):
        have = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut[i][p] for i in range(len(cut)) if have[i][p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    have = assign()
    codes = {rows[i][0]: [e for _, e in have[i]] for i in range(len(rows))}
    errors = {rows[i][0]: sum(d for d, _ in have[i]) for i in range(len(rows))}
    return codes, errors, books


@pytest.mark.parametrize("rounds", [0, 1, 2, 5])
def test_codes_equal_whole_scans(spark, rounds):
    draw = random.Random(rounds)
    # few different values, so that ties, unused entries and entries that stay are common
    rows = [(i * 3, [draw.choice([-0.02, -0.005, 0.0, 0.004, 0.01, 0.3]) for _ in range(8)]) for i in range(160)]
    codes, errors, books = plain_lloyd(rows, 4, 12, rounds)
    table = spark.createDataFrame([(i, v, i % 4) for i, v in rows], "vec_id long, embedding array<double>, label int")
    made = activelloyd.compress(table.repartition(5), parts=4, entries=12, rounds=rounds)
    assert made.codebooks.tolist() == books
    found = made.codes.collect()
    assert {r["vec_id"]: r["code"] for r in found} == codes
    assert {r["vec_id"]: r["error"] for r in found} == errors


def test_active_entries_give_what_a_rescan_gives():
    draw = np.random.default_rng(3)
    for _ in range(50):
        cut = draw.integers(-4, 5, (40, 3, 2))
        books = draw.integers(-4, 5, (3, 9, 2))
        entry, distance = activelloyd.rescan(cut, books)
        later = books.copy()
        moved = draw.random((3, 9)) < 0.3
        later[moved] = draw.integers(-4, 5, (int(moved.sum()), 2))
        active = activelloyd.reassign(cut, later, (later != books).any(axis=2), entry, distance)
        for mine, whole in zip(active, activelloyd.rescan(cut, later), strict=True):
            assert (mine == whole).all()


def test_parts_that_keep_their_entry_compare_moved_entries_only():
    cut = np.array([[[0]], [[9]]])
    books = np.array([[[0], [9], [4]]])
    moved = np.array([[False, False, False]])
    entry, distance = activelloyd.rescan(cut, books)
    # a wrong stored distance stays, as nothing moved and nothing is scanned
    kept = activelloyd.reassign(cut, books, moved, entry, distance + 7)
    assert kept[1].tolist() == (distance + 7).tolist()


ODD = [
    (1, [0.5] * 16, 1),
    (1, [0.25] * 16, None),
    (2, None, 1),
    (3, [float("nan")] + [0.1] * 15, 1),
    (4, [None] + [0.1] * 15, 1),
    (5, [float("-inf")] * 16, 1),
    (None, [-0.001] * 16, None),
    (6, [1e30] * 16, 2),
    (6, [1e30] * 16, 2),
    (7, [], 2),
    (8, [0.1] * 20, 3),
]


def test_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, v string, id int, code string, __label int"
    rows = [(*r, "x", 1, "y", 2) for r in ODD]
    made = activelloyd.compress(spark.createDataFrame(rows, schema).repartition(3))
    assert made.codebooks.shape == (16, 7, 2)  # 20 components are filled up to 32
    found = activelloyd.with_label_errors(made.codes).collect()
    assert sorted(f"{r['vec_id']} {r['label']}" for r in found) == [
        "1 1", "1 None", "6 2", "6 2", "7 2", "8 3", "None None"
    ]
    assert {(r["error"], r["label_error"]) for r in found} == {(0, 0)}
    assert max(made.codebooks.ravel()) == activelloyd.LARGEST
    assert activelloyd.decoded(made).count() == 7
    empty = activelloyd.compress(spark.createDataFrame([], schema))
    assert activelloyd.with_label_errors(empty.codes).collect() == []
    assert empty.sha256 == hashlib.sha256(b"").hexdigest()
    named = spark.createDataFrame([("b", [0.1, 0.2]), ("a", [0.3, 0.1])], "name string, e array<double>")
    made = activelloyd.compress(named, parts=2, id_col="name", vector_col="e", label_col=None)
    assert {r["name"]: r["code"] for r in made.codes.collect()} == {"a": [0, 0], "b": [1, 1]}


def test_codes_come_near_to_the_vectors(spark):
    vectors = open_table(spark, ROOT, "embeddings")
    made = activelloyd.compress(vectors)
    pairs = activelloyd.decoded(made).join(vectors, "vec_id").select("approx", "embedding").collect()
    a, b = (np.array([r[k] for r in pairs], dtype=float) for k in ("approx", "embedding"))
    assert ((a - b) ** 2).sum() < 0.2 * (b**2).sum()


# -- languages


def plain_grams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        padded = f" {word} "
        for n in (1, 2, 3):
            out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    del out[" "]
    return out


def ranked(counts, top):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:top]]


def plain_languages(rows, top):
    """{id: (language, score)} of rows (id, text, lang) by the definition."""
    learn = {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang is not None:
            learn.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {k: {g: r for r, g in enumerate(ranked(v, top))} for k, v in sorted(learn.items()) if v}
    out = {}
    for i, text, _ in rows:
        own = ranked(plain_grams(text), top)
        far = {
            lang: sum(abs(r - p[g]) if g in p else top for r, g in enumerate(own))
            for lang, p in profiles.items()
        }
        best = min(far, key=far.get, default=None)
        out[i] = (best, 1 - far[best] / (len(own) * top)) if own and far else ("und", 0.0)
    return out


def test_languages_equal_the_definition(spark):
    docs = open_table(spark, ROOT, "documents")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    found = LLM["op12_rank_profiles"].build(spark, ROOT).collect()
    want = plain_languages(rows, 300)
    assert len(found) == len(rows)
    for r in found:
        assert (r["lang_pred"], pytest.approx(r["score"])) == want[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_languages_of_documents_not_learned_from(spark):
    docs = open_table(spark, "/root/testdata/sf0.01", "documents")
    found = LLM["op12_rank_profiles"].build(spark, "/root/testdata/sf0.01").where("held_out")
    rows = found.join(docs, "doc_id").where("n_chars > 40 and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) > 100


def test_grams_of_pieces_equal_those_of_the_whole(monkeypatch):
    text = (cases.prose(3, 400) + " a b  c ñ漢字 ÉÀ 1x2 \U0001d400z").encode()
    whole = rankprofiles.ngrams(text)
    assert dict(zip((unpacked(g) for g in whole[0].tolist()), whole[1].tolist(), strict=True)) == plain_grams(text.decode())
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(rankprofiles, "PIECE", size)
        for mine, other in zip(rankprofiles.ngrams(text), whole, strict=True):
            assert mine.tolist() == other.tolist()


def unpacked(gram):
    return "".join(chr(gram >> k & 0x1FFFFF) for k in (42, 21, 0) if gram >> k & 0x1FFFFF)


def test_counts_flushed_early_are_whole(spark, monkeypatch):
    docs = open_table(spark, ROOT, "documents")
    want = rankprofiles.fit(learnable(docs))
    batches = [r for r in learnable(docs).where("lang = 'en'").selectExpr("lang", "cast(text as binary)").toArrow().to_batches(max_chunksize=7)]
    monkeypatch.setattr(rankprofiles, "FLUSH", 2000)
    total = Counter()
    for out in rankprofiles._frequencies(iter(batches)):
        for gram, n in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True):
            total[gram] += n
    top = [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[: want.top]]
    at = want.langs.index("en")
    have = {int(g): int(r) for g, r in zip(want.grams, want.ranks[:, at], strict=True) if r < want.top}
    assert sorted(have, key=have.get) == top


def test_odd_texts_have_a_language_or_none(spark):
    from pyspark.sql import functions as F

    docs = cases.documents(spark)
    carry = {"doc_id": F.col("doc_id"), "held_out": held_out(F.col("doc_id")), "score_": F.col("score")}
    model = rankprofiles.fit(learnable(docs))
    assert model.langs == ["en"]
    found = rankprofiles.predict(docs, model, carry=carry).collect()
    assert len(found) == len(cases.rows())
    unknown = sorted(str(r["doc_id"]) for r in found if r["lang_pred"] == "und")
    assert unknown == ["6", "7", "8", "None"]
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0) for r in found)
    nothing = rankprofiles.fit(learnable(cases.none(spark)))
    assert {r["lang_pred"] for r in rankprofiles.predict(docs, nothing).collect()} == {"und"}
    assert rankprofiles.predict(cases.none(spark), model, carry=carry).collect() == []
    few = spark.createDataFrame([("x", "aaa"), ("x", "bbb"), ("y", "ccc")], "lang string, text string")
    assert rankprofiles.fit(few, max_langs=1).langs == ["x"]
    bad = spark.sql("SELECT cast(X'6162FF6364' AS string) AS text")
    assert rankprofiles.predict(bad, model).first()["lang_pred"] == "en"


# -- periodic runs


def plain_runs(words, min_words=24, repeats=3):
    """All runs by comparing the words with themselves at every distance."""
    ids = np.unique(np.array(words, dtype=object).astype(str), return_inverse=True)[1] if words else np.empty(0, int)
    n, found = len(ids), {}
    for q in range(1, n // repeats + 1):
        same = np.append(np.append(False, ids[:-q] == ids[q:]), False).astype(int)
        edge = np.flatnonzero(np.diff(same))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s + q >= max(min_words, repeats * q):
                found.setdefault((s, e - s + q), q)
    return sorted((s, m, q) for (s, m), q in found.items())


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = set()
    for s, m, q in runs:
        gone.update(range(s + q, s + m))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *best,
        1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_runs_equal_the_definition(spark, sf):
    root = f"/root/testdata/{sf}"
    found = {tuple(r) for r in LLM["op13_periodic_runs"].build(spark, root).collect()}
    want = {plain_row(r["doc_id"], r["text"]) for r in open_table(spark, root, "documents").collect()}
    assert found == want
    assert sum(r[1] > 0 for r in want) > len(want) // 40


def test_runs_of_made_texts(spark):
    draw = random.Random(11)
    texts = []
    for i in range(400):
        k = draw.choice([1, 2, 3, 30])
        words = [str(draw.randrange(k)) for _ in range(draw.randint(0, 120))]
        for _ in range(draw.randint(0, 3)):
            unit = [str(draw.randrange(k)) for _ in range(draw.randint(1, 20))]
            at = draw.randint(0, len(words))
            words[at:at] = [unit[j % len(unit)] for j in range(draw.randint(0, 80))]
        gap = draw.choice([" ", "\n", " \t\r", "\x0b\x0c"])
        texts.append((str(i), gap.join(words)))
    table = spark.createDataFrame(texts, "doc_id string, text string").repartition(3)
    for min_words, repeats in ((24, 3), (7, 3), (10, 4), (3, 3)):
        found = periodic.find_runs(table, min_words=min_words, repeats=repeats).collect()
        for r in found:
            words = re.findall(r"[^\x20\x09-\x0D]+", dict(texts)[r["doc_id"]])
            runs = [tuple(x) for x in r["runs"]]
            assert runs == plain_runs(words, min_words, repeats)
            assert r["n_words"] == len(words)
            assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
    with pytest.raises(ValueError):
        periodic.find_runs(table, repeats=2)


@pytest.mark.parametrize(
    "words, runs",
    [
        (["a"] * 100_000, [(0, 100_000, 1)]),
        ([f"w{i}" for i in range(700)] * 100, [(0, 70_000, 700)]),
        ([str(bin(i).count("1") % 2) for i in range(1 << 15)], []),
        ([f"p{i % 20}" if i % 21 else f"q{i}" for i in range(60_000)], []),
    ],
)
def test_runs_of_long_texts(words, runs):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    _, _, hashes, docs = periodic.spaced_words(data, np.array([0, len(data)]))
    assert periodic.runs_of(hashes, docs, 24, 3).get(0, []) == runs


def test_odd_texts_and_their_runs(spark):
    found = periodic.find_runs(cases.documents(spark)).collect()
    assert len(found) == len(cases.rows())
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    for i in (6, 7, 8):
        assert by_id[i]["n_words"] == 0 and by_id[i]["runs"] == [] and by_id[i]["kept"] == b""
    assert [tuple(r) for r in by_id[15]["runs"]] == [(0, 210, 7)]
    assert by_id[15]["kept"] == b"THIS IS ALL UPPER!! $$$ ### %%%"
    assert periodic.find_runs(cases.none(spark)).collect() == []


def test_words_end_with_their_document():
    texts = ["a b", "", "c", " ", "d ", "", "", "e"]
    ends = np.cumsum([0] + [len(t) for t in texts])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts, stops, _, docs = periodic.spaced_words(data, ends)
    raw = data.tobytes().decode()
    assert [(raw[a:b], int(d)) for a, b, d in zip(starts, stops, docs, strict=True)] == [
        ("a", 0), ("b", 0), ("c", 2), ("d", 4), ("e", 7)
    ]
