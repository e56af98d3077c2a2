"""Distances, trees and clustering against plain numpy, on planted shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import hdbscan, mst, neighbors, reduce


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


def ari(a, b):
    a, b = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    t = np.zeros((a.max() + 1, b.max() + 1))
    np.add.at(t, (a, b), 1)
    c = lambda v: (v * (v - 1) / 2).sum()
    s, x, y, n = c(t), c(t.sum(1)), c(t.sum(0)), len(a) * (len(a) - 1) / 2
    return (s - x * y / n) / ((x + y) / 2 - x * y / n)


def moons(seed, n=400, noise=0.07):
    rng = np.random.default_rng(seed)
    t = np.linspace(0, np.pi, n // 2)
    x = np.concatenate([np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.5 - np.sin(t)]])
    return x + rng.normal(0, noise, x.shape), np.repeat([0, 1], n // 2)


def labels_of(x, mcs, ms):
    d = neighbors.distances(x, x)
    np.fill_diagonal(d, 0)
    core = np.sort(d, 1)[:, ms]
    w = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    edges = mst.prim(w)
    a, b, v = map(np.array, zip(*edges, strict=True))
    return hdbscan.select(hdbscan.condense(hdbscan.dendrogram(a, b, v, len(x)), len(x), mcs), len(x)), v.sum()


def test_blobs_in_the_cluster(spark):
    rng = np.random.default_rng(42)
    y = np.repeat([0, 1, 2], 60)
    x = rng.normal(0, 0.8, (180, 3)) + np.array([[0, 0, 0], [8, 8, 0], [-8, 8, 4]])[y]
    df = frame(spark, x)
    (want, probs), weight = labels_of(x, 10, 5)
    tree = hdbscan.spanning_tree(df, 5)
    assert tree.count() == 179
    assert tree.agg(F.sum("w")).first()[0] == pytest.approx(weight, rel=1e-9)
    got = {r.id: (r.label, r.probability) for r in hdbscan.cluster(df, 10, 5, tree=tree).collect()}
    found = np.array([got[i][0] for i in range(180)])
    assert ari(found, want) > 0.999 and ari(found[found >= 0], y[found >= 0]) > 0.95
    assert all(0 <= p <= 1 for _, p in got.values())
    sparse = hdbscan.cluster(df, 10, 5, dense=0)
    s = {r.id: r.label for r in sparse.collect()}
    assert ari(np.array([s[i] for i in range(180)]), y) > 0.8


@pytest.mark.parametrize("seed", [1, 3, 7, 11])
def test_moons(seed):
    x, y = moons(seed)
    (labels, _), _ = labels_of(x, 15, 5)
    assert ari(labels, y) > 0.9


def test_one_blob_is_noise():
    x = np.random.default_rng(0).normal(size=(60, 2))
    (labels, probs), _ = labels_of(x, 30, 5)
    assert (labels == -1).all() and (probs == 0).all()


def test_neighbours_in_blocks(spark):
    x = np.random.default_rng(3).normal(size=(90, 5))
    d = neighbors.distances(x, x)
    np.fill_diagonal(d, np.inf)
    got = neighbors.knn(frame(spark, x), 4, block=20).collect()
    near = {(r.src, r.rank): r.dst for r in got}
    order = np.argsort(d, 1)
    assert all(near[i, k + 1] == order[i, k] for i in range(90) for k in range(4))
    assert neighbors.pairwise(frame(spark, x), block=20).count() == 90 * 89 // 2


def test_forest_is_bridged(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (5, 6, 1.5)], "a long, b long, w double")
    nodes = spark.createDataFrame([(i,) for i in (0, 1, 2, 5, 6, 9)], "id long")
    tree = mst.boruvka(edges)
    assert sorted(map(tuple, tree.collect())) == [(0, 1, 1.0), (1, 2, 2.0), (5, 6, 1.5)]
    assert sorted(map(tuple, mst.bridged(tree, nodes).collect())) == [(0, 1, 1.0), (0, 5, 4.0), (1, 2, 2.0), (5, 6, 1.5), (5, 9, 4.0)]


def test_empty_and_wrong_arguments(spark):
    empty = spark.createDataFrame([], "id long, vec array<double>")
    assert hdbscan.cluster(empty, 5, 3).count() == 0
    assert reduce.pca(empty, 2).count() == 0
    with pytest.raises(ValueError):
        hdbscan.cluster(empty, 1, 3)


def test_components_keep_variance(spark):
    x = np.random.default_rng(5).normal(size=(80, 6)) @ np.diag([5, 3, 1, 0.2, 0.1, 0.1])
    y = np.array([r.vec for r in reduce.pca(frame(spark, x), 2).orderBy("id").collect()])
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(y), np.abs(u[:, :2] * s[:2]), atol=1e-6)


def test_layout_keeps_blobs_apart(spark):
    rng = np.random.default_rng(8)
    y = np.repeat([0, 1], 30)
    x = rng.normal(0, 0.3, (60, 4)) + y[:, None] * 6
    low = np.array([r.vec for r in reduce.neighbour_layout(frame(spark, x), 2, 8).orderBy("id").collect()])
    assert np.isfinite(low).all() and (np.linalg.norm(low, axis=1) <= 15.001).all()
    assert np.linalg.norm(low[y == 0].mean(0) - low[y == 1].mean(0)) > 3


def test_layout_of_a_large_table_is_no_plain_projection(spark, monkeypatch):
    """With every table a large one: the round of joins moves each point as the single task does where no draw is random."""
    rng = np.random.default_rng(9)
    n = 30
    a, b = np.arange(n - 1), np.arange(1, n)
    start = rng.normal(0, 3, (n, 2))
    edges = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(a, b, strict=True)], "a long, b long, w double")
    places = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(start)], "n long, vec array<double>")
    got = np.array([r.vec for r in reduce.spread_layout(edges, places, 2, 2, negatives=0).orderBy("n").collect()])
    assert np.allclose(got, reduce.layout((a, b, np.ones(n - 1)), start, 2, negatives=0), atol=1e-9) and not np.allclose(got, start)
    y = np.repeat([0, 1], 20)
    x = rng.normal(0, 0.3, (40, 4)) + y[:, None] * 6
    monkeypatch.setattr(reduce, "MOST_SENT", 0)
    low = np.array([r.vec for r in reduce.neighbour_layout(frame(spark, x), 2, 8, epochs=5).orderBy("id").collect()])
    plain = np.array([r.vec for r in reduce.pca(frame(spark, x), 2).orderBy("id").collect()])
    assert np.isfinite(low).all() and (np.linalg.norm(low, axis=1) <= 15.001).all()
    assert not np.allclose(low, plain) and np.linalg.norm(low[y == 0].mean(0) - low[y == 1].mean(0)) > 3


def test_ties_and_stripes_of_neighbours(spark, monkeypatch):
    """Many equal distances: the least ids, and the same in stripes of a few rows and with values that aren't numbers."""
    x = np.random.default_rng(4).integers(0, 3, (60, 2)).astype(float)
    d = neighbors.distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.lexsort((np.arange(60), d[i]))[:5]}
    monkeypatch.setattr(neighbors, "STRIPE", 7)
    for block in (25, None):
        assert {(r.src, r.dst) for r in neighbors.knn(frame(spark, x), 5, block=block).collect()} == want
    x[3] = np.nan
    far = neighbors.knn(frame(spark, x), 5).collect()
    assert {r.src for r in far} == set(range(60)) - {3} == {r.dst for r in far} | {r.src for r in far} and len(far) == 59 * 5
    y = np.array([[0.0, 2.0], [0.0, 1.0], [1.0, 0.0]]) + 1e6
    src, dst, dist = neighbors.nearest(np.array([9]), np.array([[1e6, 1e6]]), np.array([8, 7, 6]), y, 2, 6)
    assert list(zip(src.tolist(), dst.tolist(), dist.tolist(), strict=True)) == [(9, 6, 1.0), (9, 7, 1.0)]


def test_forest_of_parts_in_few_rounds(spark, monkeypatch):
    """Equal weights: the one forest of the order (w, a, b), from parts that are thinned again and again, with a fixed number of tables written."""
    rng = np.random.default_rng(6)
    pairs = sorted({(int(min(p)), int(max(p))) for p in rng.integers(0, 300, (2000, 2)) if p[0] != p[1]})
    edges = sorted((float(rng.integers(1, 5)), a, b) for a, b in pairs)
    root, want = list(range(300)), []
    for w, a, b in edges:
        x, y = a, b
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        if x != y:
            root[x] = y
            want.append((a, b, w))
    written = []
    monkeypatch.setattr(mst, "MOST_EDGES", 100)
    monkeypatch.setattr(mst, "settled", lambda df, name, f=mst.settled: written.append(name) or f(df, name))
    got = mst.boruvka(spark.createDataFrame([(a, b, w) for w, a, b in edges], "a long, b long, w double"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(written) <= 4


def test_reachable_is_the_join_of_pairs(spark):
    x = np.random.default_rng(7).normal(size=(70, 3))
    df = frame(spark, x)
    core = neighbors.core_distances(neighbors.knn(df, 4), 4)
    want = {(r.a, r.b): r.w for r in neighbors.mutual_reachability(neighbors.pairwise(df), core).collect()}
    got = {(r.a, r.b): r.w for r in neighbors.reachable(df, core, block=30).collect()}
    assert len(got) == 70 * 69 // 2 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
