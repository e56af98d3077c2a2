"""Near copies, repeated passages and near vectors against brute force."""

import math
import re
from itertools import combinations

import numpy as np
import pytest

from topicloom.llm import lines, minhash, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


def prose(rng, n, vocabulary=3000):
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


def shingles(text):
    w = [x for x in re.split(r"[^\w]+", (text or "").lower()) if x]
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def connected(sets, threshold):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and common >= threshold * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    groups = {i: find(i) for i in sets}
    size = {g: list(groups.values()).count(g) for g in set(groups.values())}
    return {i: g for i, g in groups.items() if size[g] > 1}


def near_corpus():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(30):
        w = prose(rng, int(rng.integers(30, 300)))
        rows.append((len(rows), " ".join(w)))
        for _ in range(k % 4):
            c = list(w)
            for at in rng.integers(0, len(c), max(1, len(c) // 40)):
                c[at] = "changed"
            rows.append((len(rows), " ".join(c)))
        if k % 5 == 0:
            rows.append((len(rows), " ".join(w).upper() + "!"))
    return rows


def test_groups_as_by_comparing_all(spark):
    rows = near_corpus()
    got = {r.doc_id: r.group_id for r in minhash.groups(frame(spark, rows)).collect()}
    want = connected({i: shingles(t) for i, t in rows}, minhash.THRESHOLD)
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(want[i] == g for i, g in got.items())


def test_near_copies_at_the_edges(spark):
    long = " ".join(prose(np.random.default_rng(2), 40_000))
    rows = [(1, None), (2, ""), (3, " ,;"), (None, "a b c d"), (4, "a b c d"), (5, "A b, c d"), (6, "one"), (7, "one"), (8, long), (9, long + " end"), (5, "A b, c d")]
    got = sorted(map(tuple, minhash.groups(frame(spark, rows)).collect()))
    assert got == [(4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 8)]
    docs = frame(spark, rows)
    clashing = docs.select("*", docs.text.alias("id"), docs.lang.alias("sig"), docs.lang.alias("_gone"), docs.lang.alias("lang"), docs.lang.alias("c1"))
    kept = minhash.drop_near_copies(clashing)
    assert kept.columns == clashing.columns
    assert sorted((r[0] for r in kept.collect()), key=str) == [1, 2, 3, 4, 6, 8, None]
    assert minhash.groups(frame(spark, [])).count() == 0 and minhash.drop_near_copies(frame(spark, [])).count() == 0


def test_a_chain_is_one_group(spark):
    """Members that are not like the smallest one join it by others."""
    rng = np.random.default_rng(3)
    w = prose(rng, 200)
    rows = [(0, " ".join(w))]
    for k in range(1, 7):
        w = list(w)
        for at in range(12 * k, 12 * k + 10):
            w[at] = f"new{k}_{at}"
        rows.append((k, " ".join(w)))
    assert {r.group_id for r in minhash.groups(frame(spark, rows)).collect()} == {0}


def templated(n, own, seed=12):
    """Documents of one 60-word template and their own words; each tenth has a near copy."""
    rng = np.random.default_rng(seed)
    template = prose(rng, 60)
    rows = []
    for i in range(n):
        w = template + [f"own{i}_{k}" for k in range(own)]
        rows.append((2 * i, " ".join(w)))
        if i % 10 == 0:
            rows.append((2 * i + 1, " ".join([*w[:-6], *(f"new{i}_{k}" for k in range(6))])))
    return rows


@pytest.mark.parametrize("own", [32, 60])
def test_a_template_makes_no_pair_of_each_two(spark, monkeypatch, own):
    """Near copies among documents that share much, but less than the threshold, have their groups; the pairs to verify grow as the documents."""
    made = []
    inner = minhash._prefix_pairs
    monkeypatch.setattr(minhash, "_prefix_pairs", lambda *a: made.append(inner(*a)) or made[-1])
    counts = []
    for n in (150, 300):
        rows = templated(n, own)
        got = {r.doc_id: r.group_id for r in minhash.groups(frame(spark, rows)).collect()}
        assert got == {2 * i + k: 2 * i for i in range(0, n, 10) for k in (0, 1)}
        counts.append(made[-1].count())
    assert counts[1] <= 300  # all pairs would be 54,000


def test_prefixes_miss_no_pair(spark):
    rng = np.random.default_rng(13)
    sets = [rng.choice(60, rng.integers(1, 30), replace=False) for _ in range(150)]
    sets += [np.unique(np.append(rng.permutation(s)[: max(1, len(s) * 3 // 4)], rng.integers(60, 70))) for s in sets]
    df = spark.createDataFrame([(i, sorted(int(x) for x in s)) for i, s in enumerate(sets)], "id long, set array<int>")
    got = {(r.a, r.b) for r in minhash._prefix_pairs(df.selectExpr("id", "id % 7 as root"), df, 0.5).collect()}
    own = [set(s.tolist()) for s in sets]
    want = {(a, b) for a in range(300) for b in range(a) if a % 7 != b % 7 and len(own[a] & own[b]) >= 0.5 * len(own[a] | own[b])}
    assert want <= got and len(want) > 100


def test_tensored_keys_meet_as_their_parts_do():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 32, (1, minhash.LEFT * minhash.LEFT_SIZE + minhash.RIGHT * minhash.RIGHT_SIZE), dtype=np.uint64).astype(np.uint32)
    b = a.copy()
    b[0, 0] += 1  # the first left group differs, so its RIGHT tables do and no others
    x, y = minhash.keys(a)[0], minhash.keys(b)[0]
    assert (x == y).sum() == (minhash.LEFT - 1) * minhash.RIGHT and len(set(x.tolist())) == len(x)


def test_pairs_at_the_threshold_meet_in_nine_of_ten_cases():
    rng = np.random.default_rng(11)
    for common, each in ((200, 100), (220, 90), (240, 80)):  # Jaccard 0.5, 0.55, 0.6
        h = [rng.integers(0, 1 << 63, (common + each * 2), dtype=np.uint64) for _ in range(1500)]
        sides = [minhash.keys(minhash.signatures(np.concatenate([np.delete(x, cut) for x in h]), np.arange(1501) * (common + each))) for cut in (slice(common, common + each), slice(common + each, None))]
        met = (sides[0] == sides[1]).any(1).mean()
        assert met >= 0.88  # 0.90 is expected at the threshold, with a standard error of 0.008


def brute_spans(rows, least):
    """Every line, and every least run of whole units with least words or more from a unit's start or back from a line's end, is looked up among all earlier ones."""
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]+", text)]
        if not words:
            continue
        fresh, broken = [], []
        for n, (s, _, w) in enumerate(words):
            gap = text[words[n - 1][1] : s] if n else ""
            broken.append(n == 0 or "\n" in gap)
            fresh.append(n == 0 or "\n" in gap or (bool(re.search(r"\s", gap)) and (bool(re.search(r"[.!?]", gap)) or w[0].isupper())))
        at = [n for n, f in enumerate(fresh) if f] + [len(words)]
        ranges = {(a, next((b for b in at[k + 1 :] if b - a >= least), None)) for k, a in enumerate(at[:-1])}
        line = [n for n, f in enumerate(broken) if f] + [len(words)]
        ranges |= set(zip(line, line[1:])) | {(next((a for a in reversed(at) if b - a >= least), None), b) for b in line[1:]}
        cover = []
        for a, b in sorted(r for r in ranges if None not in r):
            key = " ".join(w for _, _, w in words[a:b]).lower()
            start, end = words[a][0], words[b - 1][1]
            stop = words[b][0] if b < len(words) else len(text)
            line = text.find("\n", end)
            stop = min(stop, line) if line >= 0 else stop
            if key in seen and seen[key] != (i, start):
                cover.append((start, stop))
            seen.setdefault(key, (i, start))
        merged = []
        for s, e in cover:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(i, s, e): True for s, e in merged}
    return set(out)


def line_corpus():
    rng = np.random.default_rng(5)
    shared = [" ".join(prose(rng, 60)).capitalize() + "." for _ in range(3)]
    rows = []
    for i in range(40):
        own = ". ".join(" ".join(prose(rng, 9)).capitalize() for _ in range(8))
        if i % 4 == 0:
            at = own.find(" ", len(own) // 2)
            own = own[:at] + " " + shared[i % 3] + own[at:]  # in the middle of a sentence
        if i % 7 == 0:
            own += "\n" + shared[1]
        rows.append((i, own))
    return rows, shared


def test_passages_as_by_looking_up_all(spark):
    rows, _ = line_corpus()
    got = set(map(tuple, lines.repeated_spans(frame(spark, rows)).collect()))
    assert got == brute_spans(rows, lines.MIN_WORDS) and len(got) >= 10


def test_whole_lines_of_any_length_are_found(spark):
    """A line of 15 words in twenty pages, one of a word, and the end of a copied line that is too short for a paragraph of its own."""
    rng = np.random.default_rng(15)
    line = " ".join(prose(rng, 15))
    two = " ".join(prose(rng, 26)).capitalize() + ". " + " ".join(prose(rng, 9)).capitalize() + "."
    rows = [(i, f"{' '.join(prose(rng, 12))}\n{line.upper() if i % 2 else line}!\nMenu\n{' '.join(prose(rng, 7))} {two if i < 2 else ''}") for i in range(20)]
    got = set(map(tuple, lines.repeated_spans(frame(spark, rows)).collect()))
    assert got == brute_spans(rows, lines.MIN_WORDS)
    kept = {r.doc_id: r.text for r in lines.drop_repeated(frame(spark, rows)).collect()}
    assert sum(line in t.lower() for t in kept.values()) == sum("Menu" in t for t in kept.values()) == sum(two[-20:] in t for t in kept.values()) == 1
    only_long = lines.repeated_spans(frame(spark, rows), min_line_words=lines.MIN_WORDS).collect()
    assert [r.doc_id for r in only_long] == [1]


def test_passages_set_into_sentences_are_found_and_the_rest_stays(spark):
    rows, shared = line_corpus()
    kept = {r.doc_id: r.text for r in lines.drop_repeated(frame(spark, rows)).collect()}
    assert len(kept) == len(rows)
    for s in shared:
        assert sum(s in t for t in kept.values()) <= 1
    texts = dict(rows)
    assert all(kept[i] == texts[i] for i in texts if not any(s in texts[i] for s in shared))
    assert all(r.n_chars == len(r.text) for r in lines.drop_repeated(frame(spark, rows)).collect())


def test_passages_at_the_edges(spark):
    p = " ".join(f"word{k}" for k in range(30))
    long = " ".join(f"Sentence {k} has some seven words here." for k in range(20_000))
    rows = [(None, p), (1, None), (2, ""), (3, p), (4, p + "\nand more"), (5, "short " * 5), (6, "short " * 5), (7, long), (3, p), (9, "𝒳é " + p)]
    docs = frame(spark, rows)
    got = set(map(tuple, lines.repeated_spans(docs).collect()))
    assert (4, 0, len(p)) in got and (6, 0, 30) in got and not any(i in (None, 1, 2, 3, 5) for i, _, _ in got)
    clashing = docs.select("*", docs.lang.alias("start"), docs.lang.alias("hi"), docs.lang.alias("key"), docs.lang.alias("_s"), docs.lang.alias("lang"))
    kept = lines.drop_repeated(clashing)
    assert kept.columns == clashing.columns
    texts = [(r[0], r[1]) for r in kept.collect()]
    assert (4, "\nand more") in texts and texts.count((3, p)) == 2 and (None, p) in texts and (1, None) in texts
    assert lines.repeated_spans(frame(spark, [])).count() == 0 and lines.drop_repeated(frame(spark, [])).count() == 0


def test_texts_with_one_id_are_cut_each_by_itself(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(1, a), (2, b + " tail"), (2, a)]
    kept = sorted((r.doc_id, r.text) for r in lines.drop_repeated(frame(spark, rows)).collect())
    assert kept == [(1, a), (2, b + " tail")]


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute_links(x, threshold):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    roots = np.arange(len(x))
    while True:
        new = np.minimum(roots, np.where(s, roots[None, :], len(x)).min(1))
        new = new[new]
        if (new == roots).all():
            return roots, s.sum(1)
        roots = new


def test_links_as_by_comparing_all(spark):
    """More vectors than a block holds, with groups of copies, equal vectors and one hot group, at the settings as they are."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5200, 32))
    near = [x[k] + rng.normal(0, 0.2, 32) for k in rng.integers(0, 400, 900)]
    hot = x[7] + rng.normal(0, 0.1, (500, 32))
    x = np.concatenate([x, near, hot, np.repeat(x[:1], 20, 0)]).astype(np.float32)
    got = {r.vec_id: r for r in vectors.near_groups(vector_frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()}
    roots, links = brute_links(x, 0.9)
    mine = np.array([got[i].links for i in range(len(x))])
    assert len(got) == len(x) and (mine <= links).all() and mine.sum() >= 0.97 * links.sum() > 100_000
    assert all(roots[i] == roots[got[i].group_id] for i in range(len(x)))
    assert np.mean([got[i].group_id == roots[i] for i in np.flatnonzero(links)]) >= 0.97


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(7)
    d, errors, beyond = 64, [], 0
    a, b = rng.normal(size=(2, 60, d))
    b = a + 0.5 * b
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    each = np.arange(60)
    for k in range(60):
        r = vectors.rotation(d, k)
        e, off = vectors.estimates(vectors.encode((a @ r).astype(np.float32)), vectors.encode((b @ r).astype(np.float32)), each, each, d)
        error = e - (a * b).sum(1)
        errors.append(error)
        beyond += (np.abs(error) > off).sum()
    assert abs(np.mean(errors)) < 0.005 and beyond <= 0.001 * 3600


def test_codes_let_no_link_go():
    rng = np.random.default_rng(8)
    for d in (8, 64, 100, 768):
        a = rng.normal(size=(300, d))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        o = rng.normal(size=(300, d))
        o -= (o * a).sum(1, keepdims=True) * a
        o /= np.linalg.norm(o, axis=1, keepdims=True)
        b = 0.91 * a + np.sqrt(1 - 0.91**2) * o
        r = vectors.rotation(d, 0)
        x, y = vectors.likely(vectors.encode((a @ r).astype(np.float32)), vectors.encode((b @ r).astype(np.float32)), 0.9, d)
        found = set(zip(x.tolist(), y.tolist(), strict=True))
        assert sum((k, k) in found for k in range(300)) >= 299 and (d < 64 or len(found) < 0.02 * 90_000)


def test_vectors_at_the_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [nan, 1.0]), (8, [inf, 0.0]), (None, [1.0, 0.0]), (9, [1.0, None]), (1, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.9, math.sqrt(0.19)])]
    want = {1: (1, 2), 2: (1, 2), 11: (1, 2), **{i: (i, 0) for i in (3, 4, 5, 6, 7, 8, 9, 10)}}
    df = vector_frame(spark, rows)
    for frame_ in (df, df.selectExpr("*", "1 as rep", "2 as keys", "'x' as id", "3 as links", "4 as v")):
        got = {r.vec_id: (r.group_id, r.links) for r in vectors.near_groups(frame_, 0.95).collect()}
        assert got == want | {12: (12, 0)}
    named = df.selectExpr("'k' || vec_id as vec_id", "embedding")
    assert {r.vec_id: r.links for r in vectors.near_groups(named, 0.95).collect()}["k11"] == 2
    assert vectors.near_groups(vector_frame(spark, [])).count() == 0
    long = [(k, [float(x) for x in np.random.default_rng(k % 2).normal(size=3000)]) for k in range(4)]
    assert {r.vec_id: (r.group_id, r.links) for r in vectors.near_groups(vector_frame(spark, long)).collect()} == {0: (0, 1), 1: (1, 1), 2: (0, 1), 3: (1, 1)}


def test_low_thresholds_compare_all_pairs_in_one_table(spark):
    """So many tables as a low threshold asks for would send each vector to all of them with all its keys."""
    assert vectors.plan(100_000, 0.4, 1e-9) == (0, 1) and vectors.plan(100_000, 0.9)[0] == 7
    rng = np.random.default_rng(17)
    x = rng.normal(size=(300, 24))
    got = vectors.near_groups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 0.4, miss=1e-9).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.4
    np.fill_diagonal(near, False)
    assert {r.vec_id: r.links for r in got} == dict(enumerate(near.sum(1).tolist()))
