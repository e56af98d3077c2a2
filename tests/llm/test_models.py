"""Toxicity, quality and the language model: held-out accuracy, brute-force gradients and likelihoods, and odd input."""

import numpy as np
import pytest

from topicloom.llm import quality, recurrent, toxicity

FOLDER = "/root/testdata/sf0.01"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def toxic_corpus(n=400):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{k}" for k in rng.integers(0, 500, int(rng.integers(20, 120)))]
        bad = i % 5 == 0
        if bad:
            for k in range(4):
                w[k * 4] = ["scumlike", "scummy", "vilest", "vile"][int(rng.integers(0, 4))]
        rows.append((i, " ".join(w)))
        labels.append((i, None, int(bad)))
    return rows, labels


def test_toxic_held_out(spark):
    rows, labels = toxic_corpus()
    model = toxicity.fit(docs_of(spark, rows), labels_of(spark, [x for x in labels if x[0] % 2]))
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs_of(spark, rows), model).collect()}
    held = [(got[i] >= 0.5) == bool(t) for i, _, t in labels if i % 2 == 0]
    assert np.mean(held) > 0.97 and len(model.index) < 1 << 14


def test_ftrl_as_coordinate_by_coordinate():
    rng = np.random.default_rng(2)
    examples = [np.unique(rng.integers(0, 30, 6)) for _ in range(50)]
    y = (np.array([5 in e for e in examples])).astype(float)
    m = toxicity.ftrl(examples, y, bits=5, alpha=0.5, l1=0.1, l2=0.2, epochs=2, seed=3)
    z, n, bz, bn, order = {}, {}, 0.0, 0.0, np.random.default_rng(3)
    weight = lambda j: 0.0 if abs(z.get(j, 0)) <= 0.1 else -(z[j] - np.sign(z[j]) * 0.1) / ((1 + np.sqrt(n[j])) / 0.5 + 0.2)
    for _ in range(2):
        for i in order.permutation(50):
            w = {j: weight(j) for j in examples[i].tolist()}
            b = -bz / ((1 + np.sqrt(bn)) / 0.5)
            g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - y[i]
            for j in w:
                old = n.get(j, 0.0)
                z[j] = z.get(j, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / 0.5 * w[j]
                n[j] = old + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / 0.5 * b
            bn += g * g
    dense = m.dense()
    assert all(dense[j] == pytest.approx(weight(j), abs=1e-6) for j in z)


def test_toxicity_at_the_edges(spark):
    rows, labels = toxic_corpus(100)
    rows += [(200, None), (201, ""), (None, "scumlike vile scumlike vile scummy"), (202, "plain " * 50_000), (0, rows[0][1])]
    labels += [(None, 1, 1), (3, 1, None), (0, 0, 0), (201, 1, 0)]
    docs = docs_of(spark, rows)
    odd = docs.selectExpr("*", "text as toxicity", "1 as _w", "2 as c0", "3 as toxic")
    kept = toxicity.drop_toxic(odd, labels_of(spark, labels))
    assert kept.columns == odd.columns
    ids = [r[0] for r in kept.collect()]
    assert {200, 201, 202, 1} <= set(ids)
    assert {r.doc_id: r.toxicity for r in toxicity.score(docs, toxicity.fit(docs, labels_of(spark, labels))).collect()}[200] == 0.0
    none = labels_of(spark, [])
    assert toxicity.toxic_rows(docs, none).count() == 0 and toxicity.drop_toxic(docs, none).count() == len(rows)
    assert toxicity.drop_toxic(docs_of(spark, []), labels_of(spark, labels)).count() == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.filter("doc_id % 2 = 1"))
    got = {r.doc_id: r.tail_probability for r in quality.score(docs, model).collect()}
    held = labels.filter("doc_id % 2 = 0").collect()
    good = [got[r.doc_id] >= 0.5 for r in held if r.quality == 1]
    bad = [got[r.doc_id] < 0.5 for r in held if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.7


def test_grades_in_order(spark):
    """Five grades told by how many of the words are good ones."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(500):
        share = rng.random()
        rows.append((i, " ".join(rng.choice(["good", "fine"]) if rng.random() < share else rng.choice(["poor", "weak"]) for _ in range(60))))
        labels.append((i, min(4, int(share * 5)), 0))
    model = quality.fit(docs_of(spark, rows), labels_of(spark, [x for x in labels if x[0] % 2]))
    assert (np.diff(model.thresholds) > 0).all() and model.grades.tolist() == [0, 1, 2, 3, 4]
    got = {r.doc_id: r for r in quality.score(docs_of(spark, rows), model, at_least=3).collect()}
    held = [x for x in labels if x[0] % 2 == 0]
    assert np.corrcoef([got[i].expected_grade for i, _, _ in held], [g for _, g, _ in held])[0, 1] > 0.9
    assert np.mean([(got[i].tail_probability >= 0.5) == (g >= 3) for i, g, _ in held]) > 0.85


def test_quality_at_the_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "word"), (None, "word"), (5, "Lorem ipsum " * 50_000), (4, "word"), (6, "\u0000 é🙂")]
    docs, labels = docs_of(spark, rows), labels_of(spark, [(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (4, 0, 0), (99, 1, 1)])
    model = quality.fit(docs, labels)
    got = quality.score(docs.selectExpr("*", "1 as expected_grade", "2 as _t"), model).collect()
    assert len(got) == len(rows)
    assert all(r.tail_probability == 0 and r.expected_grade == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(np.isfinite(r.tail_probability) for r in got)
    assert quality.select(docs, labels_of(spark, [])).count() >= 0
    assert quality.select(docs_of(spark, []), labels).count() == 0
    one = quality.fit(docs, labels_of(spark, [(4, 1, 0)]))
    assert {r.expected_grade for r in quality.score(docs, one).collect()} == {1.0}


def test_hashes_are_of_the_tokens_wherever_they_stand():
    text = "Ab cd Ab\tcd. x".encode()
    r, f, n = quality.features(np.frombuffer(text + b"Ab cd", np.uint8), np.array([0, len(text), len(text) + 5]))
    assert n.tolist() == [5, 2]
    words = [f[k] for k in range(7)]
    assert words[0] == words[2] == words[5] and words[1] == words[3] == words[6] and words[0] != words[1]


def slow(net, ids):
    """Log-likelihood of one document, a step and a full softmax at a time."""
    p, n = {k: v.astype(float) for k, v in net.p.items()}, net.h
    h, last, total = np.zeros(n), recurrent.END, 0.0
    for w in ids:
        gx, gh = p["x"][last], h @ p["u"] + p["bu"]
        r, z = (1 / (1 + np.exp(-(gx[s] + gh[s]))) for s in (slice(0, n), slice(n, 2 * n)))
        c = np.tanh(gx[2 * n :] + r * gh[2 * n :])
        h = (1 - z) * c + z * h
        k, i = divmod(int(w), net.width)
        for logits, at in ((h @ p["c"] + p["bc"], k), (h @ p["w"][k] + p["bw"][k], i)):
            total += logits[at] - np.log(np.exp(logits).sum())
        last = w
    return total


def test_state_is_carried_over_windows_and_lanes():
    rng = np.random.default_rng(5)
    net = recurrent.Net(50, 6)
    docs = [np.array([*rng.integers(1, 50, int(k)), recurrent.END], np.int32) for k in [1, 15, 16, 17, 90, 3, 40]]
    for lanes in (1, 3, 256):
        got = recurrent.run(net, docs, False, lanes=lanes)
        assert got == pytest.approx([slow(net, d) for d in docs], rel=1e-4)


def test_slopes_of_a_window():
    net = recurrent.Net(40, 4)
    net.flat = net.flat.astype(np.float64)
    net.p = net.views(net.flat)
    rng = np.random.default_rng(6)
    given, wanted, start = rng.integers(0, 40, (5, 3)), rng.integers(0, 40, (5, 3)), np.zeros((3, 4), np.float32)

    def loss():
        hs, _ = net.forward(given, start)
        return -float(net.losses(hs[1:].reshape(-1, 4), wanted.ravel())[0].astype(float).sum())

    flat = np.zeros_like(net.flat)
    grad = net.views(flat)
    hs, kept = net.forward(given, start)
    _, dh = net.losses(hs[1:].reshape(-1, 4), wanted.ravel(), grad)
    net.backward(hs, kept, dh.reshape(5, 3, 4), grad)
    for i in rng.choice(len(flat), 40, replace=False):
        old = net.flat[i]
        net.flat[i] = old + 1e-2
        up = loss()
        net.flat[i] = old - 1e-2
        down = loss()
        net.flat[i] = old
        assert (up - down) / 2e-2 == pytest.approx(flat[i], abs=2e-3)


def test_trained_model_beats_word_counts(spark):
    """The next word follows from the one before it, which counts of words can't tell."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        w = [int(rng.integers(0, 20))]
        for _ in range(80):
            w.append((w[-1] * 3 + 1) % 20 if rng.random() < 0.9 else int(rng.integers(0, 20)))
        rows.append((i, " ".join(f"t{k}" for k in w)))
    known, net = recurrent.train(docs_of(spark, rows).coalesce(1), size=64, rate=0.03)
    got = recurrent.score(docs_of(spark, rows), known, net).collect()
    assert len(known) == 20 and {r.n_tokens for r in got} == {82}
    assert np.exp(-sum(r.log_likelihood for r in got) / sum(r.n_tokens for r in got)) < 15


def test_language_model_at_the_edges(spark):
    rows = [(1, None), (2, ""), (3, "..."), (None, "one two"), (4, "one two"), (4, "one two"), (5, "one two " * 30_000)]
    got = recurrent.log_likelihoods(docs_of(spark, rows).selectExpr("*", "1 as k", "2 as n_tokens"), size=16).collect()
    by = {(r.doc_id, r.n_tokens): r for r in got}
    assert len(got) == 7 and by[1, 0].perplexity is None and by[3, 0].log_likelihood == 0
    assert by[4, 3].log_likelihood == pytest.approx(by[None, 3].log_likelihood) and by[5, 60_001].log_likelihood < 0
    assert recurrent.log_likelihoods(docs_of(spark, [])).count() == 0


def test_rare_words_are_spelled(spark):
    often = [(i, " ".join(f"w{k}" for k in range(i % 2, 2400, 2))) for i in range(60)]
    rare = [(1000, "abcab abcabc bcabca"), (1001, "xqzjv kwvzq zzqxj"), (1002, "abcabd"), (1003, "w1 w3 w5"), (1004, "é")]
    docs = docs_of(spark, often + [(2000 + i, "abcabc abcab cabca") for i in range(9)] + rare)
    known, net = recurrent.train(docs)
    assert len(known) == 2046 and net.v == 2048
    got = {r.doc_id: r for r in recurrent.score(docs_of(spark, rare), known, net).collect()}
    assert got[1000].n_tokens == got[1001].n_tokens and got[1003].perplexity < got[1000].perplexity < got[1001].perplexity / 10
    spell = net.spell
    for before in ((256, 256), (97, 98), (5, 6)):
        assert sum(spell.likelihood((before[0] * 257 + before[1]) * 257 + c) for c in range(257)) == pytest.approx(1, abs=1e-5)


def test_spelling_by_single_bytes():
    some = ["abc", "a", "é", "abca", "x" * 300, "b"]
    code, at = recurrent.Spelling.codes(some)
    for k, w in enumerate(some):
        x = [256, 256, *w.encode(), 256]
        assert code[at[k] : at[k + 1]].tolist() == [(a * 257 + b) * 257 + c for a, b, c in zip(x, x[1:], x[2:], strict=False)]
    own, n = np.unique(code, return_counts=True)
    spell = recurrent.Spelling(own, n.astype(float))
    logs = [sum(float(spell.table[c]) for c in code[at[k] : at[k + 1]]) for k in range(len(some))]
    assert spell.logs(some) == pytest.approx(logs, rel=1e-5) and len(spell.logs([])) == 0


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    a, b = ({r.doc_id: r.log_likelihood for r in recurrent.log_likelihoods(docs.repartition(n), shard=50_000).collect()} for n in (2, 16))
    assert len(a) == 1000 and all(abs(a[i] - b[i]) <= 1e-5 * (1 + abs(a[i])) for i in a)


def test_plain_text_is_likelier_than_nonsense(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    known, net = recurrent.train(docs.filter("doc_id % 2 = 0"))
    held = recurrent.score(docs.filter("doc_id % 2 = 1 and length(text) > 300"), known, net)
    odd = docs_of(spark, [(k, " ".join(f"{c}qxzj{c}{c}kvw" for c in "bdfghjklmnp")) for k in range(3)])
    assert recurrent.score(odd, known, net).agg({"perplexity": "min"}).first()[0] > held.selectExpr("percentile(perplexity, 0.95)").first()[0]
