"""Minimum spanning trees: one task for a full matrix, forests of parts of the edges for any other graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled

#: Edges that a task holds before it thins them, and forests that are joined into one.
MOST_EDGES, FAN = 2_000_000, 8


def prim(w: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges (from the tree, new node, weight) of a full matrix, from node 0."""
    n = len(w)
    best, source, done = w[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    done[0] = True
    out = []
    for _ in range(n - 1):
        best[done] = np.inf
        k = int(np.argmin(best))
        out.append((int(source[k]), k, float(best[k])))
        done[k] = True
        closer = ~done & (w[k] < best)
        best[closer], source[closer] = w[k][closer], k
    return out


def forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of the spanning forest, which is unique since edges are ordered by (w, a, b): in each round every tree takes its least edge out."""
    order = np.lexsort((b, a, w))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)][order], ends[len(a) :][order]
    root, at, picked = np.arange(len(nodes)), np.arange(len(order)), []
    while True:
        live = root[x] != root[y]
        x, y, at = x[live], y[live], at[live]
        if not len(at):
            break
        cx, cy = root[x], root[y]
        # Edges are sorted, so the last one written in reverse is a tree's least.
        least = np.full(len(nodes), -1)
        both = np.empty(2 * len(at), int)
        both[0::2], both[1::2] = cx[::-1], cy[::-1]
        least[both] = np.repeat(np.arange(len(at))[::-1], 2)
        trees = np.flatnonzero(least >= 0)
        e = least[trees]
        picked.append(at[np.unique(e)])
        to = np.where(cx[e] == trees, cy[e], cx[e])
        up = np.arange(len(nodes))
        up[trees] = to
        # Two trees that chose the same edge point to each other: the smaller one is the root.
        mutual = (up[up[trees]] == trees) & (trees < to)
        up[trees[mutual]] = trees[mutual]
        while (up[up] != up).any():
            up = up[up]
        root = up[root]
    return order[np.sort(np.concatenate(picked))] if picked else np.zeros(0, int)


def _forests(edges: DataFrame, parts: int | None) -> DataFrame:
    """The edges of so many parts (None: of the partitions as they are) that are in the spanning forest of their own part; no other edge is in the whole one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def thinned() -> list[np.ndarray]:
            a, b, w = (np.concatenate(c) for c in zip(*held, strict=True))
            keep = forest(a, b, w)
            return [a[keep], b[keep], w[keep]]

        for batch in batches:
            held.append([batch.column(k).to_numpy() for k in range(3)])
            rows += batch.num_rows
            if rows > MOST_EDGES and rows > 2 * len(held[0][0]):
                held = [thinned()]
                rows = len(held[0][0])
        if held:
            yield pa.record_batch(thinned(), ["a", "b", "w"])

    plain = edges.select(F.col("a").cast("long"), F.col("b").cast("long"), F.col("w").cast("double"))
    return (plain.repartition(parts, "a", "b") if parts else plain).mapInArrow(run, "a long, b long, w double")


def boruvka(edges: DataFrame) -> DataFrame:
    """(a, b, w): the spanning forest of (a, b, w), unique since edges are ordered by (w, a, b).

    Parts of the edges are thinned to their own forests, which are joined and thinned again by FAN until one is
    left: a task holds MOST_EDGES edges or twice the nodes, and nothing goes to the driver.
    """
    # The edges are thinned where they are before any of them is shuffled.
    live = settled(_forests(edges.filter("a <> b"), None), "forest")
    parts = max(FAN, 2 * edges.sparkSession.sparkContext.defaultParallelism)
    while True:
        live = settled(_forests(live, parts), "forest")
        if parts == 1:
            return live
        parts = max(1, parts // FAN)


def bridged(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """The tree with its parts chained through their smallest nodes, at twice the greatest weight (1 without edges); one task over nodes and edges, as the hierarchy is."""
    none = F.lit(None)
    rows = tree.select("a", "b", "w").union(nodes.select(F.col("id").alias("a"), none.cast("long").alias("b"), none.cast("double").alias("w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        linked = t.filter(pc.is_valid(t.column("b")))
        ids = np.unique(t.filter(pc.is_null(t.column("b"))).column("a").to_numpy())
        a, b, w = (linked.column(c).to_numpy() for c in ("a", "b", "w"))
        every = np.unique(np.concatenate([ids, a, b]))
        x, y = np.searchsorted(every, a), np.searchsorted(every, b)
        root = np.arange(len(every))
        while True:
            # Of two linked trees the one with the larger smallest node goes under the other.
            p, q = root[x], root[y]
            if (p == q).all():
                break
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root[root] != root).any():
                root = root[root]
        heads = every[np.unique(root[np.searchsorted(every, ids)])]
        most = w.max() * 2 if len(w) else 1.0
        yield pa.record_batch([pa.array(np.concatenate([a, heads[:-1]])), pa.array(np.concatenate([b, heads[1:]])), pa.array(np.concatenate([w, np.full(max(len(heads) - 1, 0), most)]))], ["a", "b", "w"])

    return rows.repartition(1).mapInArrow(run, "a long, b long, w double")
