"""Lower-dimensional embeddings: principal components, and a neighbour-graph layout; both followed by stabilising."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import MOST_SENT, doubles, matrix, stabilize
from ..sources.tables import settled
from . import neighbors

#: The curve for a least distance of 0.1.
CURVE = 1.577, 0.895


def components(points: DataFrame, k: int, vec_col: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """Mean and the k leading components; sums of products are made in the partitions and only they reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, None, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                n, s, ss = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if ss is None else ss)
        if n:
            row = np.concatenate([[n], s, ss.ravel()])
            yield pa.record_batch([pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], ["k", "x"])

    got = points.select(doubles(F.col(vec_col))).mapInArrow(sums, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").toArrow().column("x").to_numpy()
    d = int((np.sqrt(1 + 4 * (len(got) - 1)) - 1) / 2)
    mean = got[1 : d + 1] / got[0]
    cov = got[d + 1 :].reshape(d, d) / got[0] - np.outer(mean, mean)
    _, vectors = np.linalg.eigh(cov)
    top = vectors[:, ::-1][:, :k]
    # A component's sign is free; its largest entry is made positive.
    return mean, top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])


def pca(points: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, vec) with k components, stabilised. An empty table stays empty."""
    if points.isEmpty():
        return points.select(id_col, doubles(F.col(vec_col)).alias("vec"))
    mean, top = components(points, k, vec_col)
    sent = points.sparkSession.sparkContext.broadcast((mean, top))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, top = sent.value
        for b in batches:
            y = (matrix(b.column(1)) - mean) @ top if b.num_rows else np.zeros((0, k))
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))], [id_col, "vec"])

    kind = points.schema[id_col].dataType.simpleString()
    return stabilize(points.select(id_col, doubles(F.col(vec_col))).mapInArrow(project, f"`{id_col}` {kind}, vec array<double>"), "vec", "vec")


def memberships(near: DataFrame) -> DataFrame:
    """(a, b, w), a < b: fuzzy membership of each neighbour edge, both directions joined by w + v - w * v."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.diff(b.column(1).offsets.to_numpy())
            dist, dst = b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rows = np.repeat(np.arange(len(sizes)), sizes)
            gap = dist - dist[first][rows]
            lo, hi = np.zeros(len(sizes)), np.full(len(sizes), 1e4)
            for _ in range(48):
                mid = (lo + hi) / 2
                over = np.add.reduceat(np.exp(-gap / np.maximum(mid[rows], 1e-12)), first) > np.log2(np.maximum(sizes, 2))
                hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)
            src = b.column(0).to_numpy()[rows]
            yield pa.record_batch([pa.array(src), pa.array(dst), pa.array(np.exp(-gap / np.maximum(hi[rows], 1e-12)))], ["src", "dst", "w"])

    groups = near.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst"))).alias("g")).select("src", "g.dist", "g.dst")
    w = groups.mapInArrow(fit, "src long, dst long, w double")
    both = w.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("s"), F.when(F.count("*") > 1, F.product("w")).otherwise(F.lit(0.0)).alias("p"))
    return both.select("a", "b", (F.col("s") - F.col("p")).alias("w"))


def layout(edges: tuple[np.ndarray, np.ndarray, np.ndarray], start: np.ndarray, epochs: int = 200, negatives: int = 5, seed: int = 42) -> np.ndarray:
    """Attraction along the edges and repulsion from random others, in whole rounds; moves are held within 4 and vectors within 15."""
    a, b, w = edges
    rng = np.random.default_rng(seed)
    y = start.copy()
    p, q = CURVE
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        on = rng.random(len(w)) < w / max(w.max(), 1e-12)
        i, j = a[on], b[on]
        d = y[i] - y[j]
        d2 = (d * d).sum(1, keepdims=True)
        pull = -2 * p * q * np.maximum(d2, 1e-12) ** (q - 1) / (1 + p * d2**q) * d
        pull = np.clip(pull, -4, 4) * rate
        at, by = [i, j], [pull, -pull]
        for _ in range(negatives):
            k = rng.integers(0, len(y), len(i))
            d = y[i] - y[k]
            d2 = (d * d).sum(1, keepdims=True)
            at.append(i)
            by.append(np.clip(2 * q / ((0.001 + d2) * (1 + p * d2**q)) * d, -4, 4) * rate)
        # Sums in the order of the moves, much quicker than adding each in its place.
        where, what = np.concatenate(at), np.concatenate(by)
        move = np.stack([np.bincount(where, what[:, c], len(y)) for c in range(y.shape[1])], 1)
        y += np.clip(move, -4, 4)
        y *= np.minimum(15 / np.sqrt((y * y).sum(1, keepdims=True) + 1e-8), 1)
    return y


def spread_layout(edges: DataFrame, start: DataFrame, k: int, epochs: int = 200, negatives: int = 5, seed: int = 42) -> DataFrame:
    """(n, vec): layout() as rounds of joins over edges (a, b, w) and positions (n, vec), n from 0 on without gaps; the draws are hashes of edge and round."""
    p, q = CURVE
    edges, y, rows = settled(edges, "edges"), settled(start, "places"), start.count()
    most = max(edges.agg(F.max("w")).first()[0] or 0.0, 1e-12)

    def clipped(x: Column) -> Column:
        return F.greatest(F.least(x, F.lit(4.0)), F.lit(-4.0))

    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        drawn = F.pmod(F.xxhash64("a", "b", F.lit(epoch), F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        on = edges.filter(drawn < F.col("w") / most)
        others = F.array(*[F.pmod(F.xxhash64("a", "b", F.lit(epoch), F.lit(seed), F.lit(j + 1)), F.lit(rows)) for j in range(negatives)])
        pairs = on.select(F.col("a").alias("n"), F.col("b").alias("m"), F.lit(True).alias("near"))
        pairs = pairs.union(pairs.select(F.col("m").alias("n"), F.col("n").alias("m"), "near"))
        pairs = pairs.union(on.select(F.col("a").alias("n"), F.explode(others).alias("m"), F.lit(False).alias("near")))
        both = pairs.join(y, "n").join(y.select(F.col("n").alias("m"), F.col("vec").alias("to")), "m")
        both = both.withColumn("d", F.zip_with("vec", "to", lambda s, t: s - t)).withColumn("d2", F.aggregate("d", F.lit(0.0), lambda s, x: s + x * x))
        pull = -2 * p * q * F.pow(F.greatest("d2", F.lit(1e-12)), F.lit(q - 1)) / (1 + p * F.pow("d2", F.lit(q)))
        push = 2 * q / ((0.001 + F.col("d2")) * (1 + p * F.pow("d2", F.lit(q))))
        both = both.withColumn("f", F.when(F.col("near"), pull).otherwise(push))
        moves = both.groupBy("n").agg(F.array(*[F.sum(clipped(F.col("f") * F.col("d")[c]) * rate) for c in range(k)]).alias("move"))
        moved = F.when(F.col("move").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "move", lambda x, m: x + clipped(m)))
        y = y.join(moves, "n", "left").select("n", moved.alias("vec"))
        shrink = F.least(15 / F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) + 1e-8), F.lit(1.0))
        y = settled(y.withColumn("s", shrink).select("n", F.transform("vec", lambda x: x * F.col("s")).alias("vec")), "places")
    return y


def neighbour_layout(points: DataFrame, k: int = 2, n_neighbors: int = 15, id_col: str = "id", vec_col: str = "vec", epochs: int = 200) -> DataFrame:
    """(id, vec): a layout of the fuzzy neighbour graph from the principal components.

    Neighbours and memberships are found in the cluster. The layout is one task on
    the graph's edges, or beyond four times MOST_SENT bytes of them rounds of joins with the same moves and other random draws.
    """
    start = pca(points, k, id_col, vec_col)
    rows = points.count()
    if rows < 3:
        return start
    near = memberships(neighbors.knn(points, min(n_neighbors, rows - 1), id_col, vec_col))
    if rows * n_neighbors * 24 > 4 * MOST_SENT:
        start = settled(start, "start")
        ids = start.select(id_col).orderBy(id_col).rdd.zipWithIndex().map(lambda r: (r[0][0], r[1]))
        number = settled(points.sparkSession.createDataFrame(ids, f"id {start.schema[id_col].dataType.simpleString()}, n long"), "numbers")
        most = max(start.select(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0], 1e-12)
        placed = start.withColumnRenamed(id_col, "id").join(number, "id").select("n", F.transform("vec", lambda x: x / most * 10).alias("vec"))
        a, b = (number.select(F.col("id").alias(c), F.col("n").alias("n" + c)) for c in "ab")
        edges = near.join(a, "a").join(b, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"), "w")
        done = spread_layout(edges, placed, k, epochs).join(number, "n").select(F.col("id").alias(id_col), "vec")
        return stabilize(done, "vec", "vec")
    w = near.toArrow()
    first = start.orderBy(id_col).toArrow().combine_chunks()
    ids = first.column(0).to_numpy()
    y = matrix(first.column(1).chunk(0))
    y = y / max(np.abs(y).max(), 1e-12) * 10
    out = layout((np.searchsorted(ids, w.column("a")), np.searchsorted(ids, w.column("b")), w.column("w").to_numpy()), y, epochs)
    done = pa.table({id_col: first.column(0), "vec": pa.array(list(out), pa.list_(pa.float64()))})
    return stabilize(points.sparkSession.createDataFrame(done), "vec", "vec")
