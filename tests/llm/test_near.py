"""Near-duplicates, nearest neighbours and components against brute force."""

import re
from collections import defaultdict

import cases
import numpy as np
from pyspark.sql import functions as F

from martwright.llm import bitcodes, dartminhash
from martwright.llm.components import components
from martwright.llm.dartminhash import near_duplicates, throw
from martwright.llm.queries import LLM
from martwright.llm.textarrays import U, mix

SF = "/root/testdata/sf0.01"


def classes(pairs, similarity=0.8):
    """Least id of the class of each (id, text), by exact Jaccard over all pairs."""
    sets = {}
    for doc_id, text in pairs:
        w = [x.lower() for x in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].add(i)
    seen = {(a, b) for ids in by_shingle.values() if len(ids) < 400 for a in ids for b in ids if a < b}
    for a, b in seen:
        n = len(sets[a] & sets[b])
        if n >= similarity * (len(sets[a]) + len(sets[b]) - n):
            root[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for i in sorted(sets):
        least.setdefault(top(i), i)
    return {i: least[top(i)] for i in sets}


def test_query_matches_all_pairs(spark):
    got = {r.doc_id: r.class_id for r in LLM["op3_near_duplicates"].build(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == classes([(r.doc_id, r.text) for r in docs])


def test_odd_documents(spark):
    got = near_duplicates(cases.documents(spark)).collect()
    assert len(got) == len(cases.rows())
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.class_key)
    assert len(by_id[1] | by_id[2]) == 1
    assert by_id[3] == by_id[1]
    assert all(len(by_id[i]) == 1 for i in (6, 7, 8))
    assert len(by_id[6] | by_id[7] | by_id[8]) == 3
    assert near_duplicates(cases.none(spark)).count() == 0


def test_large_group_of_near_copies_is_one_class(spark):
    base = cases.prose(21, 150).split()
    texts = [" ".join([*base[:i], f"word{i}", *base[i + 1 :]]) for i in range(140)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_duplicates(df).select("class_id").distinct().count() == 1


def test_darts_estimate_weighted_similarity():
    a = np.repeat(mix(np.arange(300, dtype=U)), 2)
    b = np.concatenate([a[100:], mix(np.arange(1000, 1050, dtype=U))])
    of = np.repeat([0, 1], [len(a), len(b)])
    for weighted, want in ((False, 250 / 350), (True, 500 / 650)):
        ranks = throw(np.concatenate([a, b]), of, 2, 1000, weighted)
        assert np.isfinite(ranks).all()
        assert abs((ranks[0] == ranks[1]).mean() - want) < 0.06


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (5, 4), (4, 5), (10, 9), (9, 8), (8, 7), (7, 1), (20, 21)]
    edges += [(100, i) for i in range(101, 160)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == (
        dict.fromkeys([1, 2, 3, 7, 8, 9, 10], 1)
        | dict.fromkeys([4, 5], 4)
        | dict.fromkeys([20, 21], 20)
        | dict.fromkeys(range(100, 160), 100)
    )
    assert components(df.where("false")).count() == 0


def test_components_end_as_soon_as_all_are_stars(spark, monkeypatch):
    from martwright.llm import components as module

    rounds = []
    star = module._large_star
    monkeypatch.setattr(module, "_large_star", lambda edges: rounds.append(1) or star(edges))
    df = spark.createDataFrame([(5, 1), (1, 7), (3, 9), (9, 3)], "u long, v long")
    roots = module.components(df)
    assert {r.node: r.root for r in roots.collect()} == {1: 1, 5: 1, 7: 1, 3: 3, 9: 3}
    assert not rounds
    assert dartminhash.joined(roots, df.where("false")) is roots
    more = dartminhash.joined(roots, spark.createDataFrame([(7, 9), (20, 30)], "u long, v long"))
    assert {r.node: r.root for r in more.collect()} == {1: 1, 5: 1, 7: 1, 3: 1, 9: 1, 20: 20, 30: 20}
    assert rounds


def exact(ids, vectors, asked, k=5):
    out = set()
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    for q in asked:
        at = int(np.flatnonzero(ids == q)[0])
        score = (vectors * vectors[at]).sum(axis=1) / (norms * norms[at])
        others = np.flatnonzero(ids != q)
        best = others[np.lexsort((ids[others], -score[others]))][:k]
        out |= {(q, r + 1, int(ids[i]), float(score[i])) for r, i in enumerate(best)}
    return out


def test_neighbours_match_brute_force(spark):
    got = {tuple(r) for r in LLM["op7_bitcodes"].build(spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in table])
    vectors = np.array([r.embedding for r in table], dtype=np.float64)
    want = exact(ids, vectors, [int(i) for i in ids if i % 50 == 0])
    near = {x[:3] for x in got}
    assert len(near & {x[:3] for x in want}) >= 0.99 * len(want)
    score = {x[:3]: x[3] for x in want}
    assert all(abs(x[3] - score[x[:3]]) < 1e-12 for x in got if x[:3] in score)


def test_odd_vectors(spark):
    inf = float("inf")
    rows = [
        (0, [1.0, 0.0, 0.5], "x"),
        (1, [2.0, 0.0, 1.0], "x"),
        (2, [1.0, 0.0, 0.5], "x"),
        (2, [1.0, 0.0, 0.5], "x"),
        (3, None, "x"),
        (4, [0.0, 0.0, 0.0], "x"),
        (5, [1.0, None, 0.0], "x"),
        (6, [1.0, float("nan"), 0.0], "x"),
        (7, [inf, 0.0, 0.0], "x"),
        (8, [], "x"),
        (9, [1.0, 1.0], "x"),
        (None, [1.0, 0.0, 0.5], "x"),
        (10, [-1.0, 0.0, 0.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim string")
    got = bitcodes.nearest(df, F.col("vec_id") % 10 == 0, block_rows=2).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got)] == [
        (0, 1, 1),
        (0, 2, 2),
        (0, 3, 2),
        (0, 4, 10),
        (10, 1, 0),
        (10, 2, 1),
        (10, 3, 2),
        (10, 4, 2),
    ]
    assert bitcodes.nearest(df.where("false"), F.lit(True)).count() == 0


def test_bounds_hold():
    draw = np.random.default_rng(5)
    vectors = draw.standard_normal((2000, 48))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    turn = bitcodes.rotation(48, 1)
    codes, scalar = bitcodes.encode(vectors, turn)
    low, high = bitcodes.bounds(codes, scalar, 48, bitcodes.byte_sums(vectors[0], turn), 4.0)
    truth = vectors @ vectors[0]
    assert ((low <= truth) & (truth <= high)).mean() > 0.999


def test_links_inside_a_crowd_below_the_threshold(spark):
    """Two near-copies among many texts of one template that are no near-copies of each other."""
    draw = np.random.default_rng(8)
    base = cases.prose(31, 400).split()
    texts = []
    for i in range(600):
        words = list(base)
        for place in draw.choice(400, 13, replace=False):
            words[place] = f"own{i}x{place}"
        texts.append(words)
    for i in range(0, 120, 2):
        texts[i + 1] = list(texts[i])
        for place in draw.choice(400, 9, replace=False):
            texts[i + 1][place] = f"twin{i}x{place}"
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(sets)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
                root[max(top(a), top(b))] = min(top(a), top(b))
    want = {i: top(i) for i in range(len(sets))}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert len(set(want.values())) > 400
    assert got == want


def test_classes_of_many_blocks(spark, monkeypatch):
    """Two large classes of one key and some texts beside them: only blocks of different classes meet."""
    rows = [(7, i, 1 if i < 40 else 2 if i < 80 else i, 10) for i in range(90)]
    members = spark.createDataFrame(rows, "key long, node long, root long, n_words long")
    monkeypatch.setattr(dartminhash, "BLOCK_TEXTS", 8)
    got = dartminhash.block_pairs(members).collect()
    met = defaultdict(lambda: (set(), set()))
    for r in got:
        met[r.pair][r.low].add(r.node)
    pairs = set()
    for high, low in met.values():
        pairs |= {(min(a, b), max(a, b)) for a in low for b in (high or low)}
    root = {r[1]: r[2] for r in rows}
    assert {(a, b) for a in root for b in root if a < b and root[a] != root[b]} <= pairs
    assert not any(root[a] == root[b] for a, b in pairs if a != b)


def test_links_that_no_leader_has(spark):
    """With one band every twin pair that shares the key of the crowd is linked, not only the leaders'."""
    base = cases.prose(31, 400).split()
    rows = []
    for i in range(120):
        own = [f"own{i // 2}x{j}" if j % 30 == i // 2 % 30 else w for j, w in enumerate(base)]
        rows.append((i, " ".join([*own[:-1], f"end{i}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_duplicates(df, bands=1, rows=1).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 120, 2)) > 40
