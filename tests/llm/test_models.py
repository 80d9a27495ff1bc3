"""Decontamination, quality classifier and the pipeline."""

import random
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from martwright.llm import factors, latent
from martwright.llm.dartminhash import near_duplicates
from martwright.llm.queries import LLM, held_out
from martwright.llm.textarrays import words

SF = "/root/testdata/sf0.01"


def normal(text):
    data = np.frombuffer((text or "").lower().encode(), np.uint8)
    return words(data, np.array([0, len(data)]))[2].tolist()


def contains(text, part):
    return any(text[i : i + len(part)] == part for i in range(len(text) - len(part) + 1))


def test_leaks_are_the_verbatim_ones(spark):
    docs = [
        (r.doc_id, normal(r.text))
        for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ]
    items = [
        (r.item_id, normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    ]
    sets = {d: set(w) for d, w in docs}
    want = {
        (d, i) for i, part in items for d, w in docs if set(part) <= sets[d] and contains(w, part)
    }
    got = {(r.doc_id, r.item_id) for r in LLM["op8_latent"].build(spark, SF).collect()}
    assert want
    assert want <= got
    assert len(got - want) <= 0.02 * len(want)


def test_paraphrases_and_odd_documents(spark):
    item = cases.prose(77, 40).split()
    draw = random.Random(1)
    some = set(draw.sample(range(32), 10))
    paraphrase = [f"other{i}" if i in some else w for i, w in enumerate(item)]
    around = cases.prose(78, 300)
    docs = cases.documents(spark).select("doc_id", "text")
    leaked = spark.createDataFrame(
        [
            (100, f"{around} {' '.join(item)} {around}"),
            (101, f"{around}\n{' '.join(paraphrase).upper()}\n{around}"),
            (102, " ".join(item[::-1])),
            (103, " ".join(item)),
            (103, " ".join(item)),
        ],
        docs.schema,
    )
    benchmark = spark.createDataFrame(
        [(1, " ".join(item)), (2, None), (3, ""), (4, "too short"), (None, cases.prose(1, 40))],
        "item_id long, text string",
    )
    got = latent.leaks(docs.union(leaked), benchmark, block_items=2).collect()
    assert Counter((r.doc_id, r.item) for r in got) == Counter([(100, 1), (101, 1), (103, 1)])
    assert latent.leaks(cases.none(spark), benchmark).count() == 0
    assert latent.leaks(docs, benchmark.where("false")).count() == 0


@pytest.mark.parametrize("cells, spread", [(1 << 22, 64), (40, 2), (1, 0)])
def test_no_passage_that_weighs_enough_on_a_piece_is_left(monkeypatch, cells, spread):
    """The bound is the weight on the piece where no term is common, and never below it."""
    monkeypatch.setattr(latent, "CELLS", cells)
    monkeypatch.setattr(latent, "SPREAD", spread)
    draw = np.random.default_rng(2)
    idf = draw.random(latent.BUCKETS).astype(np.float32)
    terms = [draw.choice(60, draw.integers(1, 12)).astype(np.int64) for _ in range(20)]
    reach = latent.Reach(terms, idf, 0.5, 4)
    passages = [draw.choice(90, draw.integers(0, 15)).astype(np.int64) for _ in range(50)]
    places = [x[x >= 0] for x in (reach.place[p] for p in passages)]
    ends = np.append(0, np.cumsum([len(x) for x in places]))
    whole = np.array([(idf[p].astype(float) ** 2).sum() for p in passages])
    found = set(zip(*(x.tolist() for x in reach.groups(np.concatenate(places), ends, whole)), strict=True))
    want = {
        (i, j // 4)
        for i, p in enumerate(passages)
        for j, t in enumerate(terms)
        if (idf[p[np.isin(p, t)]].astype(float) ** 2).sum() >= 0.25 * whole[i]
    }
    assert want <= found
    if spread == 64:
        assert found == want
    assert latent.Reach([], idf, 0.5, 4).pieces == 0


def paraphrases(spark, share, seed=9):
    """Documents and (document, item) of 200 benchmark texts with a share of words replaced."""
    draw = random.Random(seed)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    words = [w for _, t in docs for w in t.split()]
    hosts = [(d, t) for d, t in docs if len(t.split()) > 40]
    made, truth = [], set()
    for n in range(200):
        item = items[n % len(items)]
        text = item.text.split()
        for i in draw.sample(range(len(text)), round(share * len(text))):
            text[i] = draw.choice(words)
        host = draw.choice(hosts)[1].split()
        at = draw.randrange(len(host))
        made.append((1_000_000 + n, " ".join([*host[:at], *text, *host[at:]])))
        truth.add((1_000_000 + n, item.item_id))
    return docs, made, truth


def test_paraphrases_are_found_and_clean_documents_are_not(spark):
    docs, made, truth = paraphrases(spark, 0.3)
    before = {r.doc_id for r in LLM["op8_latent"].build(spark, SF).collect()}
    table = spark.createDataFrame(docs + made, "doc_id long, text string")
    got = {(r.doc_id, r.item) for r in latent.leaks(table, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert len(got & truth) >= 0.9 * len(truth)
    assert {d for d, _ in got if d < 1_000_000} <= before
    # Hosts that leak a text themselves bring it along; nothing else is found in them.
    assert len({(d, i) for d, i in got - truth if d >= 1_000_000}) <= 0.1 * len(truth)


def test_short_benchmark_texts_are_found(spark):
    """Verbatim leaks of texts of 1 to 31 words inside long documents, whatever their weight there."""
    common = cases.prose(50, 40).split()
    draw = random.Random(5)

    def crowd(n):
        return " ".join(draw.choice(common) for _ in range(n))

    items = [(n, " ".join(f"{common[(n + i) % 40]}" + ("q" if i == n - 1 else "") for i in range(n))) for n in (1, 2, 5, 7, 8, 9, 12, 31)]
    fresh = [cases.prose(700 + n, 250) for n, _ in items]
    rows = [(n, f"{fresh[i]} {t.upper()}, {fresh[i][::-1]}") for i, (n, t) in enumerate(items)]
    rows += [(100 + i, crowd(300)) for i in range(40)] + [(200, None), (201, ""), (202, items[-1][1][:-2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame([*items, (50, items[2][1]), (51, "!?")], "item_id long, text string")
    got = {(r.doc_id, r.item) for r in latent.leaks(docs, benchmark).collect()}
    texts = {i: normal(t) for i, t in rows}
    want = {
        (d, i) for d, w in texts.items() for i, t in [*items, (50, items[2][1])] if contains(w, normal(t))
    }
    assert want <= got
    assert {(n, n) for n, _ in items} <= want


def test_gate_is_not_above_the_cosine(spark, monkeypatch):
    seen = []
    reach = latent.Reach

    def keep(*args):
        seen.append(args[2])
        return reach(*args)

    monkeypatch.setattr(latent, "Reach", keep)
    benchmark = spark.createDataFrame([(1, cases.SHARED)], "item_id long, text string")
    docs = cases.documents(spark)
    assert latent.leaks(docs, benchmark).count() == 2
    latent.leaks(docs, benchmark, gate=0.9, cosine=0.3)
    assert seen == [0.35, 0.3]


def test_common_share():
    weight = np.array([1.0, 2.0, 3.0, 4.0])
    piece = np.array([1, 2, 3, 4])
    assert latent.common_share(piece, np.array([9, 1, 9, 3, 4, 2]), weight) == pytest.approx(0.8)
    assert latent.common_share(piece, np.array([4, 3, 2, 1]), weight) == pytest.approx(0.4)
    assert latent.common_share(piece, np.array([], dtype=int), weight) == 0


def test_latent_space_keeps_the_strong_directions(spark):
    draw = np.random.default_rng(2)
    n, rows = 40, 300
    groups = draw.integers(0, n // 4, rows)
    terms = [np.append(4 * g + np.arange(4), draw.integers(0, n, 1)) for g in groups]
    df = spark.createDataFrame(
        [(t.tolist(), 2.0) for t in terms], "terms array<int>, norm double"
    )
    own = latent.Rows(np.arange(4), np.array([4]), np.array([2.0]))
    space = latent.latent_space(df, own, np.ones(n), np.arange(n), 10, 1.0, 1)
    every = latent.Rows(
        np.concatenate([*terms, own.terms]), np.array([5] * rows + [4]), np.full(rows + 1, 2.0)
    )
    matrix = latent.project(every, np.ones(n), np.eye(n))
    best = np.linalg.svd(matrix, full_matrices=False)[2][:10]
    kept, most = np.linalg.norm(matrix @ space) ** 2, np.linalg.norm(matrix @ best.T) ** 2
    assert kept > 0.97 * most
    left = draw.standard_normal((rows + 1, 3))
    assert np.allclose(latent.back(every, np.ones(n), left), matrix.T @ left)


def test_quality_on_held_out_labels(spark):
    got = LLM["op10_factors"].build(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    test = got.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in test)
    assert np.mean([r.predicted == r.quality for r in test]) > 0.97
    good = sorted(r.score for r in test if r.quality == 1)
    bad = [r.score for r in test if r.quality == 0]
    assert np.mean([np.searchsorted(good, b) / len(good) for b in bad]) < 0.05


def test_forward_equals_all_pairs():
    draw = np.random.default_rng(4)
    size = factors.SLOTS + factors.N_STATS
    model = factors.Model(
        draw.standard_normal(size),
        draw.standard_normal((size, factors.RANK)),
        0.3,
        draw.standard_normal(factors.N_STATS),
        np.ones(factors.N_STATS),
    )
    text = b"Some words, some numbers 12 and 12!"
    slots, count, stats = factors.features(
        np.frombuffer(text, np.uint8), np.array([0, len(text), len(text)]), np.array([35.0, 0.0])
    )
    logit = model.forward(slots, count, stats)[0]
    for d, own in ((0, slots), (1, [])):
        names = [*own, *range(factors.SLOTS, size)]
        values = [*([1 / len(own)] * len(own) if len(own) else []), *(stats[d] - model.centre)]
        want = 0.3 + sum(model.weights[i] * x for i, x in zip(names, values, strict=True))
        for a in range(len(names)):
            for b in range(a):
                pull = model.factors[names[a]] @ model.factors[names[b]]
                want += pull * values[a] * values[b]
        assert logit[d] == pytest.approx(want)


def test_gradient_matches_differences():
    draw = np.random.default_rng(6)
    size = factors.SLOTS + factors.N_STATS
    text = b"alpha beta alphagamma beta delta"
    at = np.array([0, 10, 10, len(text)])
    parts = factors.features(np.frombuffer(text, np.uint8), at, np.array([3.0, 0.0, 9.0]))
    label = np.array([1.0, 0.0, 1.0])
    theta = draw.normal(0, 0.3, size * (factors.RANK + 1) + 1)

    def model(t):
        return factors.Model(
            t[:size], t[size:-1].reshape(size, -1), t[-1], np.zeros(factors.N_STATS), np.ones(factors.N_STATS)
        )

    grad = model(theta).gradient(*parts, label)[2]
    spots = [parts[0][0], factors.SLOTS + 2, size + parts[0][1] * factors.RANK + 3, len(theta) - 1]
    spots.append(size + (factors.SLOTS + 4) * factors.RANK + 1)
    for i in spots:
        step = np.zeros_like(theta)
        step[i] = 1e-5
        up = model(theta + step).gradient(*parts, label)[0]
        down = model(theta - step).gradient(*parts, label)[0]
        assert grad[i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_scores_of_odd_documents(spark):
    docs = cases.documents(spark)
    labels = spark.createDataFrame(
        [(1, 1), (2, 1), (4, 1), (5, 1), (15, 0), (11, 0), (6, None), (None, 0), (15, 0)],
        "doc_id long, quality int",
    )
    model = factors.fit(docs, labels, steps=10)
    scored = factors.score(docs, model, carry={"row": F.struct(*docs.columns)}).collect()
    assert len(scored) == len(cases.rows())
    assert all(0 <= r.score <= 1 for r in scored)
    empty = factors.fit(docs, labels.where("false"))
    none = factors.score(docs, empty, carry={"doc_id": F.col("doc_id")}).select("score").distinct()
    assert none.count() >= 1
    assert factors.score(cases.none(spark), model, carry={}).count() == 0


def test_a_step_sends_no_more_gradients_than_parts(spark, monkeypatch):
    docs = spark.range(60).selectExpr("id doc_id", "concat('some words of text ', id % 7) text")
    labels = spark.range(60).selectExpr("id doc_id", "cast(id % 2 as int) quality")
    frame, sent = type(docs), []
    collect = frame.collect

    def counted(self):
        rows = collect(self)
        if "gradient" in self.columns:
            sent.append((len(rows), sum(r["rows"] for r in rows)))
        return rows

    monkeypatch.setattr(frame, "collect", counted)
    many = {"spark.sql.files.maxRecordsPerFile": "2", "spark.sql.files.maxPartitionBytes": "8192"}
    before = {k: spark.conf.get(k) for k in many}
    try:
        for k, v in many.items():
            spark.conf.set(k, v)
        factors.fit(docs, labels, steps=2, parts=3)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sent) == 2
    assert all(n <= 3 and rows == 60 for n, rows in sent)


def test_steps_open_no_file(spark, monkeypatch):
    docs = spark.range(60).selectExpr("id doc_id", "concat('some words of text ', id % 7) text")
    labels = spark.range(60).selectExpr("id doc_id", "cast(id % 2 as int) quality")
    frame, plans = type(docs), []
    collect = frame.collect

    def seen(self):
        if "gradient" in self.columns:
            plans.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    monkeypatch.setattr(frame, "collect", seen)
    kept = spark.sparkContext._jsc.getPersistentRDDs
    before = kept().size()
    factors.fit(docs, labels, steps=3)
    assert len(plans) == 3
    assert all("InMemoryTableScan" in p for p in plans)
    assert kept().size() == before


def test_held_out_ids(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert got.pop(None) is False
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        kept[name] = docs
        assert docs.columns[: len(names)] == names
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in kept["quality"].collect()}
    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    marked = [r.doc_id for r in known if r.doc_id in labels]
    assert np.mean([(i in good) == (labels[i] == 1) for i in marked]) > 0.97
    classes = near_duplicates(kept["quality"]).collect()
    groups = defaultdict(list)
    for r in classes:
        groups[r.class_key].append(r.doc_id)
    single = {r.doc_id for r in kept["near_duplicates"].collect()}
    assert single == {min(g) for g in groups.values()}
    leaked = {r.doc_id for r in latent.leaks(kept["near_duplicates"], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaked
    assert {r.doc_id for r in kept["decontamination"].collect()} == single - leaked
    assert kept["secrets"].count() == kept["decontamination"].count()
    assert kept["secrets"].where("""text rlike 'token = "[0-9a-f]{40}'""").count() == 0
    last = kept["mixing"]
    sums = last.groupBy("source").agg(F.sum("mix_taken").alias("t"), F.max("mix_target").alias("g"))
    assert all(abs(r.t - r.g) <= 0.5 for r in sums.collect())


def test_pipeline_stages_on_odd_documents(spark, tmp_path):
    labels = spark.createDataFrame(
        [(1, 1, 0), (4, 1, 0), (5, 1, 0), (15, 0, 0)], "doc_id long, quality int, toxic int"
    )
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, cases.SHARED)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    docs = cases.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert out.count() <= len(cases.rows())
        assert stage(spark, cases.none(spark), str(tmp_path)).count() == 0
    clash = docs.withColumn("mix_taken", F.lit(1))
    out = corpus_pipeline.mix_sources(spark, clash, str(tmp_path))
    assert out.columns == [*clash.columns, "mix_size", "mix_target", "mix_taken_"]
    assert out.count() <= len(cases.rows())
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in kept)[1] == 1
    assert 2 not in {r.doc_id for r in kept}
    left = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in left} == {r[0] for r in cases.rows()} - {4, 5}
    assert len(left) == len(cases.rows()) - 2


def test_guard_and_registration():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}
