"""Behaviour of weighting, keywords, outliers, LDA, trends, files and the whole model on small made-up data."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions.text import tokens
from topicloom.operators import ctfidf, keywords, lda, outliers, recurrence, trends
from topicloom.plans import reports, topics
from topicloom.sources import tables

COUNTS = [(0, "cat", 5), (0, "dog", 1), (1, "dog", 4), (1, "fish", 2), (2, "fish", 1)]


def counts(spark):
    return spark.createDataFrame(COUNTS, "class int, term string, n long")


def test_ctfidf_by_hand(spark):
    got = {(r["class"], r.term): r.score for r in ctfidf.ClassTfidf().fit_transform(counts(spark)).collect()}
    average = int(13 / 3)
    assert got[0, "cat"] == pytest.approx(5 / 6 * np.log(average / 5 + 1))
    bm = {(r["class"], r.term): r.score for r in ctfidf.ClassTfidf(bm25_weighting=True, reduce_frequent_words=True).fit_transform(counts(spark)).collect()}
    assert bm[1, "fish"] == pytest.approx(np.sqrt(2 / 6) * np.log(1 + (average - 3 + 0.5) / 3.5))
    seeded = ctfidf.ClassTfidf(seed_words=["cat"], seed_multiplier=3).fit_transform(counts(spark)).filter("term = 'cat'").first().score
    assert seeded == pytest.approx(3 * got[0, "cat"])
    with pytest.raises(RuntimeError):
        ctfidf.ClassTfidf().transform(counts(spark))


def test_empty_classes_lower_the_average(spark):
    idf = {r.term: r.idf for r in ctfidf.fit(counts(spark), classes=13).collect()}
    assert idf["cat"] == pytest.approx(np.log(1 / 5 + 1))


def test_tokens(spark):
    df = spark.createDataFrame([("Ab c_d É1 x",), (None,), ("",)], "t string").select(tokens(F.col("t"), 2).alias("k"))
    assert [r.k for r in df.collect()] == [["ab", "c_d", "é1", "ab c_d", "c_d é1"], [], []]


def topic_docs(spark, rng):
    centre = np.eye(3) * 4
    rows = [(i, i % 3, [float(v) for v in centre[i % 3] + rng.normal(0, 0.1, 3)]) for i in range(30)]
    rows += [(100 + i, -1, [float(v) for v in centre[0] + rng.normal(0, 0.1, 3)]) for i in range(3)]
    return spark.createDataFrame(rows, "doc_id long, topic int, embedding array<double>")


def test_outliers(spark):
    docs = topic_docs(spark, np.random.default_rng(1))
    found = {r.doc_id: r.topic for r in outliers.by_embeddings(docs, 0.0).collect()}
    assert found == {100: 0, 101: 0, 102: 0}
    assert {r.topic for r in outliers.by_embeddings(docs, 1.01).collect()} == {-1}
    assert outliers.by_embeddings(docs.filter("topic >= 0")).count() == 0
    assert outliers.merged(docs, outliers.by_embeddings(docs)).filter("topic = -1").count() == 0


def test_keywords_and_diversity(spark):
    docs = topic_docs(spark, np.random.default_rng(2))
    rng = np.random.default_rng(3)
    words = spark.createDataFrame([(f"w{i}", [float(v) for v in np.eye(3)[i % 3] + rng.normal(0, 0.3, 3)]) for i in range(60)], "word string, vec array<double>")
    plain = keywords.keywords(docs, words, 5).collect()
    assert {r.topic for r in plain} == {0, 1, 2} and len(plain) == 15
    first = [r.score for r in sorted(plain, key=lambda r: r.rank) if r.topic == 0]
    assert first == sorted(first, reverse=True)
    mixed = keywords.diverse_keywords(docs, words, 5, 0.9).collect()
    assert {r.word for r in mixed if r.topic == 0} != {r.word for r in plain if r.topic == 0}
    assert keywords.relevant(np.array([0.9]), np.ones((1, 2)), 5, 0.5) == [0]


CORPUS = ["apple banana fruit juice", "banana fruit salad apple", "fruit juice apple pear", "apple pear fruit", "engine car wheel road", "car road wheel brake", "engine brake car wheel", "road car engine", "star moon sky night", "night sky star planet", "moon planet star sky", "sky night moon"]


def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)] + [(50, ""), (51, None)], "doc_id long, text string")


def test_lda(spark, tmp_path):
    model = lda.Lda(topics=3, iterations=6, method="batch").fit(corpus(spark))
    theta = {r.doc_id: r.theta for r in model.doc_topics().collect()}
    assert set(theta) == {*range(12), 50, 51}
    assert all(sum(t) == pytest.approx(1) for t in theta.values()) and theta[50] == pytest.approx([1 / 3] * 3)
    sums = model.beta.select(F.posexplode("beta").alias("k", "b")).groupBy("k").agg(F.sum("b").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in sums)
    assert model.topic_words(4).count() == 12 and len(model.described(3)) == 3
    model.save(str(tmp_path / "m"))
    again = lda.Lda.load(spark, str(tmp_path / "m"))
    one, two = (m.transform(corpus(spark), 3).orderBy("doc_id").collect() for m in (model, again))
    assert all(a.theta == pytest.approx(b.theta) for a, b in zip(one, two, strict=True))
    with pytest.raises(ValueError):
        lda.Lda().transform(corpus(spark))


def test_lda_gets_better(spark):
    docs = corpus(spark)
    terms = lda.frequent_terms(docs).select("term")
    c = tables.settled(lda.term_counts(docs, ["doc_id"]).join(terms, "term"), "c")
    beta, theta = lda.initial_topics(terms, 3), lda.even(c, 3)
    before = lda.perplexity(c, theta, beta).first()[0]
    for _ in range(4):
        theta = tables.settled(lda.e_step(c, theta, beta, 3, 0.01), "t")
        beta = tables.settled(lda.m_step(c, theta, beta, 3, 0.01), "b")
    assert lda.perplexity(c, theta, beta).first()[0] < before


def test_sliding_windows_leave_the_last_out(spark):
    t0 = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(i, i % 2, t0 + dt.timedelta(hours=i)) for i in range(300)], "id long, topic int, ts timestamp")
    steps = trends.raw_trends(docs, 100, 50).select("step").distinct().count()
    assert steps == len(range(0, 300 - 100, 50))
    assert trends.raw_trends(docs.filter("id < 100"), 100, 50).count() == 0
    none = trends.raw_trends(docs, 100, 50, topic_ids=[7]).collect()
    assert none and all(r.proportion == 0 for r in none)


def test_bins_between_are_interpolated(spark):
    found = spark.createDataFrame([(0, 1, [1.0, 0.0]), (0, 3, [3.0, 2.0]), (1, 0, [5.0, 5.0])], "topic int, bin int, vec array<double>")
    wanted = spark.createDataFrame([(0,), (1,), (2,)], "topic int")
    got = {(r.topic, r.bin): r.vec for r in trends.interpolated(found, wanted, 5).collect()}
    assert got[0, 0] == [1, 0] and got[0, 2] == [2, 1] and got[0, 4] == [3, 2]
    assert got[1, 0] == [5, 5] and got[1, 1] == [0, 0] and got[2, 3] == [0, 0]


def test_recurrent_net_slopes():
    rng = np.random.default_rng(0)
    net = recurrence.Lstm(3, 4, 2, layers=2, shares=False)
    x, y = rng.normal(size=(5, 2, 3)), rng.normal(size=(5, 2, 2))
    out, kept, _ = net.forward(x)
    grad = net.backward(kept, 2 * (out - y))
    for k, p in net.p.items():
        at = tuple(rng.integers(0, s) for s in p.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = ((net.forward(x)[0] - y) ** 2).sum()
        p[at] = old - 1e-5
        down = ((net.forward(x)[0] - y) ** 2).sum()
        p[at] = old
        assert (up - down) / 2e-5 == pytest.approx(grad[k][at], rel=1e-4, abs=1e-6)


def test_forecast_is_shares():
    x = np.abs(np.random.default_rng(1).normal(size=(12, 3)))
    x /= x.sum(1, keepdims=True)
    y = recurrence.forecast(x, 4, 8, 5)
    assert y.shape == (4, 3) and np.allclose(y.sum(1), 1) and (y >= 0).all()
    assert recurrence.smooth(x, 8, 5).shape == x.shape


def test_files(spark, tmp_path):
    k = spark.createDataFrame([(0, 1, "a", 0.5), (0, 2, "b", 0.25), (3, 1, "é", 1.0)], "topic int, rank int, word string, score double")
    (tmp_path / "k.json").write_text(tables.keywords_json(k), encoding="utf-8")
    assert sorted(map(tuple, tables.read_keywords(spark, str(tmp_path / "k.json")).collect())) == sorted(map(tuple, k.collect()))
    x = np.arange(12, dtype=np.float32).reshape(6, 2)
    np.save(tmp_path / "x.npy", x)
    assert [r.vec for r in tables.read_npy(spark, str(tmp_path / "x.npy")).orderBy("row").collect()] == x.tolist()
    paths = reports.write_pages({"key_words": k}, str(tmp_path / "html"), "T: ")
    assert "<td>é</td>" in open(paths[0], encoding="utf-8").read()


def test_whole_model(spark):
    rng = np.random.default_rng(4)
    themes = ["apple pear fruit juice salad", "engine car wheel road brake", "star moon planet sky night"]
    docs = spark.createDataFrame([(i, " ".join(rng.permutation(themes[i % 3].split())) + f" n{i:02d}") for i in range(60)], "doc_id long, text string")
    centre = rng.normal(size=(3, 16)) * 5
    vecs = spark.createDataFrame([(i, [float(v) for v in centre[i % 3] + rng.normal(0, 0.3, 16)]) for i in range(60)], "doc_id long, embedding array<float>")
    model = topics.TopicModel(components=3, min_cluster_size=10, min_samples=3, top_n_words=3)
    found = {r.doc_id: r.topic for r in model.fit_transform(docs, vecs).collect()}
    assert len({t for t in found.values() if t >= 0}) == 3
    words = model.words().collect()
    assert len(words) == 9 and {r.word for r in words} <= set(" ".join(themes).split())
    model.representation = "nearest"
    assert model.words().count() == 9
    assert model.reduce_outliers().filter("topic = -1").count() == 0
    made = topics.hashing_embedder(8)(docs, "doc_id", "text").first().embedding
    assert np.linalg.norm(made) == pytest.approx(1, abs=1e-5)


def test_outliers_without_common_words_get_the_lowest_topic(spark):
    from topicloom.operators import outliers

    scores = spark.createDataFrame([(1, "a", 0.5), (3, "b", 0.5), (2, "c", -0.4)], "topic int, term string, score double")
    counts = spark.createDataFrame([(10, "b", 2), (11, "zz", 1), (12, "c", 1)], "doc_id long, term string, n long")
    ids = spark.createDataFrame([(10,), (11,), (12,), (13,)], "doc_id long")
    got = {r.doc_id: (r.topic, r.sim) for r in outliers.by_ctfidf(counts, scores, ids=ids).collect()}
    assert got == {10: (3, 1.0), 11: (1, 0.0), 12: (1, 0.0), 13: (1, 0.0)}
    assert {r.doc_id: r.topic for r in outliers.by_ctfidf(counts, scores, 0.1).collect()} == {10: 3, 11: -1, 12: -1}
    assert outliers.by_ctfidf(counts, scores.filter("false")).count() == 0


def test_packed_steps_are_those_of_the_counts(spark, monkeypatch):
    docs = corpus(spark).union(spark.createDataFrame([(3, "apple road"), (60, "unseen")], "doc_id long, text string"))
    monkeypatch.setattr(lda, "CHUNK", 40)
    words, packed, chunks = lda.pack(docs)
    assert chunks > 1
    n = docs.select("doc_id").distinct().count()
    terms = lda.vocabulary(words, n)
    c = lda.term_counts(docs, ["doc_id"]).join(terms, "term")
    beta = lda.initial_topics(terms, 3)
    theta = lda.e_step(c, lda.even(c, 3), beta, 3, 0.2)
    swept = lda.sweep(packed, words, beta, chunks, 3, 0.2, sums=True)
    got = {r.doc_id: r.theta for r in lda.thetas(swept).filter("words > 0").collect()}
    want = {r.doc_id: r.theta for r in theta.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    got = {r.term: r.beta for r in lda.m_step_of(swept, beta, 3, 0.1).collect()}
    want = {r.term: r.beta for r in lda.m_step(c, theta, beta, 3, 0.1).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_lda_goes_online_by_its_counts_and_not_by_a_matrix_it_never_makes(spark):
    docs = corpus(spark)
    batch = lda.Lda(topics=3, iterations=2, method="batch").fit(docs).topic_words(4).collect()
    assert lda.Lda(topics=3, iterations=2, memory_limit_gb=1e-6).fit(docs).topic_words(4).collect() == batch


def test_transform_query_takes_all_steps(spark):
    from topicloom.plans import catalog

    d = "/root/testdata/sf0.001"
    docs = tables.table(spark, d, "documents")
    want = {r.doc_id: r.theta for r in lda.Lda(topics=5, iterations=3).fit(docs).transform(docs, 30).collect()}
    got = {}
    for r in catalog.lda_transform(spark, d).collect():
        got.setdefault(r.doc_id, {})[r.topic] = r.share
    assert all([got[k][i] for i in range(5)] == pytest.approx(want[k]) for k in want)


def test_net_keeps_its_results_and_little_for_a_step(spark, monkeypatch):
    """Plain steps give the same outputs, in pieces too, and what is kept is a few arrays and no objects for each step."""
    monkeypatch.setattr(recurrence, "PIECE", 3)
    rng = np.random.default_rng(2)
    net = recurrence.Lstm(3, 4, 2, layers=2, shares=False)
    x = rng.normal(size=(8, 2, 3))
    want = x
    for k in range(2):
        hid, cell, out = np.zeros((2, 4)), np.zeros((2, 4)), []
        for row in want:
            z = np.concatenate([row, hid], 1) @ net.p[f"w{k}"] + net.p[f"b{k}"]
            i, f, o = (1 / (1 + np.exp(-z[:, 4 * c : 4 * c + 4])) for c in range(3))
            cell = f * cell + i * np.tanh(z[:, 12:])
            hid = o * np.tanh(cell)
            out.append(hid)
        want = np.array(out)
    y, kept, _ = net.forward(x)
    assert np.allclose(y, want @ net.p["head"] + net.p["bias"], atol=1e-12)
    assert all(isinstance(a, np.ndarray) for layer in kept[0] for a in layer)
    dy = rng.normal(size=y.shape)
    grad = net.backward(kept, dy)
    at = (1, 5)
    for k in ("w0", "w1"):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-6
        up = (net.forward(x)[0] * dy).sum()
        net.p[k][at] = old - 1e-6
        down = (net.forward(x)[0] * dy).sum()
        net.p[k][at] = old
        assert (up - down) / 2e-6 == pytest.approx(grad[k][at], rel=1e-5, abs=1e-8)


def test_word_vectors_are_means_over_batches(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 12, rng.integers(0, 6))) for _ in range(40)]
    vecs = rng.normal(size=(40, 3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "doc_id long, embedding array<double>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = keywords.word_vectors(docs, vectors)
        got = {r.word: r.vec for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {w: vecs[[w in t.split() for t in texts]].mean(0) for w in {x for t in texts for x in t.split()}}
    assert got.keys() == want.keys() and all(got[w] == pytest.approx(want[w]) for w in want)
    assert "Generate" not in made._jdf.queryExecution().toString()


def test_bm25_shuffles_each_text_once(spark):
    from topicloom.plans import catalog

    plan = catalog.bm25_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # Counts are made where a document's text already is: no shuffle by document and term.
    assert "hashpartitioning(doc_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning(doc_id" in x and "term" in x.split("hashpartitioning")[1].split(")")[0]]
