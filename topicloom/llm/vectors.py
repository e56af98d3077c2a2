"""Embedding near-dedup: binary codes of randomly rotated vectors with stored correction factors tell which pairs need exact recomputation.

A vector o of length 1 is rotated and reduced to its signs, the code. With f, the product of o's rotation with its
code over the root of the dimensions, the code's product with another vector q, over f, is an unbiased estimate of <o, q>; it is
off by more than SURE * sqrt((1 / f**2 - 1) / (d - 1)) only with a tiny probability. Here q is held in
four bits a coordinate, rounded up or down by a fixed random share, so a product is four counts of common bits. A pair is out if too many bits of the
two codes differ, or if the estimate of either side with its bound stays below the threshold; the others are recomputed from the vectors.

Pairs are looked for among vectors that agree in the first bits of one of several rotations. Their number of bits
grows with the logarithm of the vectors, and the number of rotations so that a pair at the threshold is missed in all with probability MISS at most.
Where a low threshold or miss asks for as many rotations as there are buckets, all vectors are one bucket instead, and no pair is missed.
Equal vectors are one in the search. The work goes to pairs of blocks; no pair leaves its block: a block gives each vector's number of links and
the edges that connect what it found, so rows grow like the vectors. Vectors that are like each other but not equal are compared each with each: a bucket of n such takes n * n / 2 comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, id_kind, lists, small_batches, written

THRESHOLD = 0.9
SURE = 4.0
MISS = 0.01
#: Vectors of a bucket that the number of bits aims at, the least bits of a key, and vectors of a block, which is compared with another at once.
BUCKET, LEAST_BITS, BLOCK = 1024, 3, 2048
_PLANES = 4


def rotation(dims: int, k: int) -> np.ndarray:
    """The k-th random rotation of so many dimensions; the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([dims, k]).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def plan(vectors: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """Bits of a bucket's key, and tables; (0, 1), every pair in one bucket, where so many tables would compare no fewer pairs than there are."""
    bits = max(LEAST_BITS, round(math.log2(max(vectors, 1) / BUCKET)))
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    tables = max(1, math.ceil(math.log(miss) / math.log(max(1 - agree, 1e-12))))
    return (bits, tables) if tables < 2**bits else (0, 1)


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    short = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, short))), axis=1).view(np.uint64)


def encode(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, factor, planes, scale) of rotated rows of length 1: the signs in words, f, the four bits of each coordinate as four rows of words, and (least, step, sum of the bits' values)."""
    n, d = rotated.shape
    low = rotated.min(1)
    step = np.maximum((rotated.max(1) - low) / (2**_PLANES - 1), 1e-12)
    share = np.random.default_rng([d, 1 << 20]).random(d)
    q = np.minimum(np.floor((rotated - low[:, None]) / step[:, None] + share), 2**_PLANES - 1).astype(np.uint8)
    planes = np.stack([_words(q >> k & 1) for k in range(_PLANES)], 1)
    return _words(rotated > 0), (np.abs(rotated).sum(1) / math.sqrt(d)).astype(np.float32), planes, np.stack([low, step, q.sum(1)], 1).astype(np.float32)


def estimates(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the products of rows x of a with rows y of b by the codes of a and the planes of b, and how far they may be off."""
    code, f = a[0][x], np.maximum(a[1][x], 1e-6)
    planes, (low, step, total) = b[2][y], b[3][y].T
    common = sum(np.bitwise_count(code & planes[:, k]).sum(1, dtype=np.int64) << k for k in range(_PLANES))
    ones = np.bitwise_count(code).sum(1, dtype=np.int64)
    root = math.sqrt(d)
    estimate = (low * (2 * ones - d) + step * (2 * common - total)) / root / f
    return estimate, SURE * (np.sqrt(np.maximum(1 / f**2 - 1, 0) / max(d - 1, 1)) + step / 2 / f)


def likely(a: tuple, b: tuple, threshold: float, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b of the pairs that may reach the threshold."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    most = math.ceil(d * p + SURE * math.sqrt(d * p * (1 - p)))
    xs, ys = [], []
    for at in range(0, len(a[0]), 256):
        part = a[0][at : at + 256]
        apart = np.bitwise_count(part[:, None, 0] ^ b[0][None, :, 0])
        if part.shape[1] > 1:
            apart = apart.astype(np.uint16)
            for w in range(1, part.shape[1]):
                apart += np.bitwise_count(part[:, None, w] ^ b[0][None, :, w])
        # In places of the flat array, which is quicker than by rows and columns.
        x, y = np.divmod(np.flatnonzero(apart.ravel() <= most), len(b[0]))
        x += at
        e, off = estimates(a, b, x, y, d)
        x, y = x[e + off >= threshold], y[e + off >= threshold]
        e, off = estimates(b, a, y, x, d)
        x, y = x[e + off >= threshold], y[e + off >= threshold]
        xs.append(x)
        ys.append(y)
    return np.concatenate(xs) if xs else np.zeros(0, int), np.concatenate(ys) if ys else np.zeros(0, int)


def _cells(batches: Iterator[pa.RecordBatch], marks: int, work: Callable) -> Iterator[pa.RecordBatch]:
    """work(mark, rows) for each run of rows with the same first columns, which are sorted by them."""
    now, held = None, []
    for batch in batches:
        m = np.stack([batch.column(k).to_numpy() for k in range(marks)], 1)
        cuts = np.flatnonzero((m[1:] != m[:-1]).any(1)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(m)], strict=True):
            if e > s:
                mark = tuple(m[s].tolist())
                if mark != now and held:
                    yield from work(now, pa.Table.from_batches(held).combine_chunks())
                    held = []
                now = mark
                held.append(batch.slice(s, e - s))
    if held:
        yield from work(now, pa.Table.from_batches(held).combine_chunks())


def _rows(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """A column of binaries of one length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _earlier(a: np.ndarray, b: np.ndarray, t: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pairs met in a table before t."""
    met = np.zeros(len(x), bool)
    for k in range(t):
        met |= a[x, k] == b[y, k]
    return met


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Edges that connect what the pairs connect, n - 1 at most."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    left, right = [], []
    # The pairs of one x in a row need x's root once for most of them.
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        if root[i] == root[j]:
            continue
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            left.append(i)
            right.append(j)
    return left, right


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", miss: float = MISS) -> DataFrame:
    """(vec_id, group_id, links) of every id: the smallest id that it is connected to by links, and its number of links, to others whose cosine with it is threshold or more (threshold in (-1, 1]).

    A pair at the threshold is missed with probability miss at most, one above it more seldom; nothing that isn't a link is counted.
    Ids may be of any type that sorts. Rows with a null id are left out. A null, empty or
    zero vector, or one that has a null or a value that isn't finite, has no links and is its own group; vectors of different lengths have
    none with each other. Rows that share an id are one vector, for which the one of the least digest stands. Equal
    vectors are links of each other, ties at the threshold count, and vectors may be of any length. An empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kind = id_kind(vectors, id_col)
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    plain = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter("id is not null")
    sound = plain.filter("size(v) > 0").filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = lists(b.column(1))
            raw = memoryview(np.ascontiguousarray(values + 0.0)).cast("B")
            own = [raw[8 * x : 8 * y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in own), "<i8").reshape(-1, 2)
            yield pa.record_batch([b.column(0), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array([bytes(x) for x in own], pa.binary())], ["id", "hi", "lo", "v"])

    kept = written(sound.mapInArrow(digest, f"id {kind}, hi long, lo long, v binary"), "vectors")
    ids = written(kept.groupBy("id").agg(F.min(F.struct("hi", "lo")).alias("s")).select("id", "s.*"), "ids")
    classes = written(ids.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.count("*").alias("m")), "classes")
    own = kept.withColumnRenamed("id", "rep").join(classes, ["rep", "hi", "lo"]).select("rep", "m", "v").dropDuplicates(["rep"])
    bits, tables = plan(classes.count(), threshold, miss)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, list[np.ndarray]] = {}
        for b in batches:
            sizes = np.array([len(x) // 8 for x in b.column(1).to_pylist()])
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                x = _rows(b.column(1).take(pa.array(rows)), np.float64)
                x = x / np.abs(x).max(1, keepdims=True)
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
                turn = turns.setdefault(d, [rotation(d, k) for k in range(max(1, -(-tables * bits // d)) + 1)])
                packed, f, planes, scale = encode(x @ turn[0])
                # Keys take their bits from further rotations, d to each.
                signs = np.concatenate([x @ r > 0 for r in turn[1:]], axis=1)[:, : tables * bits].reshape(len(x), tables, bits)
                keys = signs @ (1 << np.arange(bits, dtype=np.int64))
                cols = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (packed, planes, scale, keys)]
                yield pa.record_batch([b.column(0).take(pa.array(rows)), pa.array(np.full(len(x), d, np.int32)), cols[0], pa.array(f), cols[1], cols[2], cols[3], pa.array(list(keys), pa.list_(pa.int64()))], ["rep", "d", "code", "f", "planes", "scale", "keys", "each"])

    coded = written(own.select("rep", "v").mapInArrow(code, f"rep {kind}, d int, code binary, f float, planes binary, scale binary, keys binary, each array<long>"), "codes")
    # A bucket of more than BLOCK vectors is cut into blocks, and each pair of blocks is work by itself.
    spread = coded.select("rep", "d", F.posexplode("each").alias("t", "key"))
    sizes = spread.groupBy("t", "d", "key").agg(F.count("*").alias("n")).filter("n > 1").select("t", "d", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    table = coded.select("rep", "d", F.posexplode("each").alias("t", "key"), "code", "f", "planes", "scale", "keys").join(sizes, ["t", "d", "key"])
    placed = table.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["t", "d", "key", "i", "j"]
    cells = placed.select("t", "d", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "code", "f", "planes", "scale", "keys").repartition(*cell).sortWithinPartitions(*cell)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(mark: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            t, d, key, i, j = mark
            side = rows.column("own").to_numpy()
            n = len(side)
            parts = _rows(rows.column("code"), np.uint64), rows.column("f").to_numpy(), _rows(rows.column("planes"), np.uint64).reshape(n, _PLANES, -1), _rows(rows.column("scale"), np.float32)
            keys = _rows(rows.column("keys"), np.int64)
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            x, y = likely(tuple(p[left] for p in parts), tuple(p[right] for p in parts), threshold, d)
            x, y = left[x], right[y]
            keep = x < y if i == j else np.ones(len(x), bool)
            x, y = x[keep], y[keep]
            fresh = ~_earlier(keys, keys, t, x, y)
            found = np.unique(np.concatenate([x[fresh], y[fresh]]))
            if len(found):
                at = pa.array(found)
                yield pa.record_batch([*[c.combine_chunks().take(at) for c in rows.select(["t", "d", "key", "i", "j", "own", "rep", "keys"]).columns]], ["t", "d", "key", "i", "j", "own", "rep", "keys"])

        yield from _cells(batches, 5, work)

    likely_rows = cells.mapInArrow(search, f"t int, d int, key long, i int, j int, own int, rep {kind}, keys binary")
    # Only vectors that may have a link in a cell are read again, and compared exactly there.
    again = likely_rows.join(own, "rep").select(*cell, "own", "rep", "keys", "m", "v").repartition(*cell).sortWithinPartitions(*cell)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(mark: tuple, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            t, d, key, i, j = mark
            side, m, x = rows.column("own").to_numpy(), rows.column("m").to_numpy(), _rows(rows.column("v"), np.float64)
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keys = _rows(rows.column("keys"), np.int64)
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            links, ends = np.zeros(len(side), np.int64), ([], [])
            for at in range(0, len(left), 512):
                part = left[at : at + 512]
                p, q = np.nonzero(x[part] @ x[right].T >= threshold)
                p, q = part[p], right[q]
                keep = p < q if i == j else np.ones(len(p), bool)
                p, q = p[keep], q[keep]
                fresh = ~_earlier(keys, keys, t, p, q)
                p, q = p[fresh], q[fresh]
                links += np.bincount(p, m[q], len(side)).astype(np.int64) + np.bincount(q, m[p], len(side)).astype(np.int64)
                a, b = _forest(p, q, len(side))
                ends[0].extend(a)
                ends[1].extend(b)
            a, b = _forest(np.array(ends[0], int), np.array(ends[1], int), len(side))
            some = np.flatnonzero(links)
            reps = rows.column("rep").combine_chunks()
            yield pa.record_batch([reps.take(pa.array(some)), pa.array([None] * len(some), reps.type), pa.array(links[some])], ["a", "b", "n"])
            yield pa.record_batch([reps.take(pa.array(a, pa.int64())), reps.take(pa.array(b, pa.int64())), pa.array(np.zeros(len(a), np.int64))], ["a", "b", "n"])

        yield from _cells(batches, 5, work)

    found = written(again.mapInArrow(exact, f"a {kind}, b {kind}, n long"), "found")
    linked = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null")).select(F.col("id").alias("rep"), "root")
    each = classes.join(linked, "rep", "left").join(roots, "rep", "left").select("hi", "lo", F.coalesce("root", "rep").alias("group_id"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("links"))
    result = plain.select("id").distinct().join(ids, "id", "left").join(each, ["hi", "lo"], "left")
    return result.select(F.col("id").alias("vec_id"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


def oracle(threshold: float) -> str:
    """DuckDB SQL for near_groups over embeddings, whose ids are unique and vectors sound."""
    return f"""
with recursive v as materialized (select vec_id, embedding::double[] as e from embeddings where vec_id is not null),
p as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= {threshold}),
reach as (select vec_id as id, vec_id as r from v union select reach.id, p.b from reach join p on p.a = reach.r),
groups as (select id, min(r) as g from reach group by id),
counts as (select a, count(*) as n from p group by a)
select v.vec_id, g.g as group_id, coalesce(c.n, 0) as links from v join groups g on g.id = v.vec_id left join counts c on c.a = v.vec_id
"""
