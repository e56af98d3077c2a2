"""Quality classifier: ordinal cumulative-link regression on graded ratings, with one hashed-text weight vector and ordered thresholds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, lists, mix, small_batches

BITS = 18
#: Bound of the labelled rows that a fit uses; they are drawn by the hash of their id.
MAX_LABELLED = 12_000
#: Bytes of text whose features are made at a time; it bounds memory only.
CHUNK = 2 << 20
_P = np.uint64(0x100000001B3)
_shape = np.arange(256, dtype=np.uint8)
_shape[ord("0") : ord("9") + 1] = ord("0")
_shape[ord("A") : ord("Z") + 1] = ord("A")
_shape[ord("a") : ord("z") + 1] = ord("a")
_shape[128:] = ord("a")
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_letter = np.arange(256, dtype=np.uint8)
_letter[ord("A") : ord("Z") + 1] += 32
_letter[:128][[not chr(i).isalnum() for i in range(128)]] = 0


def _run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of stretches of bytes."""
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        powers = np.cumprod(np.full(len(data), _P, np.uint64))
        back = np.cumprod(np.full(len(data), inverse, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers * (data > 0))])
        return mix((total[ends] - total[starts]) * back[starts])


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of the words, shapes and neighbouring pairs of each in the rows' UTF-8 bytes, and the tokens of each row.

    A token is a run without white space; its word has its letters and digits in
    lower case (of ASCII), its shape the kinds of its characters, runs of one kind as one.
    """
    rows = len(offsets) - 1
    inside = ~_space[data]
    # Rows don't run into each other.
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = np.unique(cuts[inside[cuts] & inside[cuts - 1]]) if len(cuts) else cuts
    starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), cuts]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), cuts]))
    row = np.searchsorted(offsets, starts, "right") - 1
    tokens = np.bincount(row, minlength=rows)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), tokens
    shape = _shape[data]
    first = np.ones(len(data), bool)
    first[1:] = shape[1:] != shape[:-1]
    first[starts] = True
    kept = np.concatenate([[0], np.cumsum(first)])
    shapes = _run_hashes(shape[first], kept[starts], kept[ends])
    words = _run_hashes(_letter[data], starts, ends)
    shift = np.uint64(64 - bits)
    same = row[1:] == row[:-1]
    out, at = [], []
    with np.errstate(over="ignore"):
        for h, salt in ((words, 0x9E3779B97F4A7C15), (shapes, 0xC2B2AE3D27D4EB4F)):
            s = np.uint64(salt)
            out += [mix(h ^ s) >> shift, (mix(h[:-1] * s + h[1:]) >> shift)[same]]
            at += [row, row[:-1][same]]
    return np.concatenate(at), np.concatenate(out).astype(np.int64), tokens


@dataclass
class Model:
    """P(grade >= grades[k + 1]) = sigmoid(score - thresholds[k]); thresholds ascend."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray
    bits: int = BITS

    def tails(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): probability of each grade but the lowest, or a higher one."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -35, 35)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades) if len(self.grades) > 1 else np.full(len(tails), float(self.grades[0]))


def ordinal(examples: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, bits: int = BITS, rate: float = 1.0, l2: float = 1e-6, epochs: int = 8, seed: int = 7) -> Model:
    """AdaGrad on the likelihood of cumulative links; examples are (buckets, values) without repeats.

    With one grade or no rows the weights are 0; no rows count as the one grade 0.
    """
    levels, y = np.unique(grades, return_inverse=True) if len(grades) else (np.zeros(1), np.zeros(0, int))
    k = len(levels) - 1
    w = np.zeros(1 << bits)
    if k == 0:
        return Model(w.astype(np.float32), np.zeros(0), levels.astype(float), bits)
    above = np.clip([(y > j).mean() for j in range(k)], 1e-6, 1 - 1e-6)
    theta = np.maximum.accumulate(-np.log(above / (1 - above)) + np.arange(k) * 1e-3)
    first, steps = theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
    g2, rng = np.full(1 << bits, 1e-8), np.random.default_rng(seed)
    t2 = np.full(k, 1e-8)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, x = examples[i]
            theta = first + np.concatenate([[0], np.cumsum(np.exp(steps))])
            s = w[at] @ x
            c = 1 / (1 + np.exp(-np.clip(s - theta, -35, 35)))  # P(y > j)
            full = np.concatenate([[1.0], c, [0.0]])
            p = max(full[y[i]] - full[y[i] + 1], 1e-9)
            slope = np.concatenate([[0.0], c * (1 - c), [0.0]])
            ds = -(slope[y[i]] - slope[y[i] + 1]) / p
            dt = np.zeros(k)
            if y[i] > 0:
                dt[y[i] - 1] += c[y[i] - 1] * (1 - c[y[i] - 1]) / p
            if y[i] < k:
                dt[y[i]] -= c[y[i]] * (1 - c[y[i]]) / p
            g = ds * x + l2 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
            # The thresholds are the first one and logarithms of the steps between them, so they stay in order.
            d = np.concatenate([[dt.sum()], [dt[j + 1 :].sum() * np.exp(steps[j]) for j in range(k - 1)]])
            t2 += d * d
            move = 0.1 * d / np.sqrt(t2)
            first -= move[0]
            steps = np.clip(steps - move[1:], -7, 7)
    theta = first + np.concatenate([[0], np.cumsum(np.exp(steps))])
    return Model(w.astype(np.float32), theta, levels.astype(float), bits)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of rows of about CHUNK bytes; a longer text is one by itself."""
    data, offsets = _bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, **params) -> Model:
    """Fit on at most max_labelled labelled rows.

    Rows with a null id or grade are not used; an id with several grades has the
    greatest; null texts are rows without features. Grades may be any numbers.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).dropna()
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(max_labelled)
    )
    # At most max_labelled rows of two numbers, so it may be broadcast.
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).join(F.broadcast(chosen), "_id").select("_id", "_y", "_t")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in _chunks(b.column(2)):
                r, f, tokens = features(data, offsets)
                key, n = np.unique(r << BITS | f, return_counts=True)
                bounds = np.searchsorted(key >> BITS, np.arange(to - at + 1))
                x = (n / np.maximum(tokens, 1)[key >> BITS]).astype(np.float32)
                yield pa.record_batch([b.column(0).slice(at, to - at).cast(pa.int64()), b.column(1).slice(at, to - at), list_array((key & ((1 << BITS) - 1)).astype(np.int32), bounds), list_array(x, bounds)], ["_id", "_y", "_f", "_x"])

    got = rows.mapInArrow(hashed, "_id long, _y double, _f array<int>, _x array<float>").toArrow().combine_chunks()
    if got.num_rows == 0:
        return ordinal([], np.zeros(0), **params)
    order = np.argsort(got.column("_id").to_numpy(), kind="stable")
    (f, offsets), (x, _) = lists(got.column("_f").chunk(0)), lists(got.column("_x").chunk(0))
    return ordinal([(f[offsets[i] : offsets[i + 1]], x[offsets[i] : offsets[i + 1]].astype(float)) for i in order], got.column("_y").to_numpy()[order], **params)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at_least: float | None = None) -> DataFrame:
    """(id, expected_grade, tail_probability): the latter of the grade at_least (the highest by default) or a better one.

    Null and empty texts and those of white space have the lowest grade and probability 0. Repeated rows and rows with a null id are scored each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        least = m.grades[-1] if at_least is None else at_least
        tail = int(np.searchsorted(m.grades, least)) - 1
        for b in batches:
            for at, to, data, offsets in _chunks(b.column(1)):
                r, f, tokens = features(data, offsets, m.bits)
                total = np.bincount(r, m.weights[f], to - at) / np.maximum(tokens, 1)
                tails = m.tails(total)
                some = tokens > 0
                wanted = np.ones(to - at) if tail < 0 else np.zeros(to - at) if tail >= tails.shape[1] else tails[:, tail]
                yield pa.record_batch([b.column(0).slice(at, to - at), pa.array(np.where(some, m.expected(tails), m.grades[0])), pa.array(np.where(some, wanted, 0.0))], [id_col, "expected_grade", "tail_probability"])

    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).mapInArrow(scored, f"`{id_col}` {id_type}, expected_grade double, tail_probability double")


def select(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, at_least: float | None = None, **params) -> DataFrame:
    """(doc_id, expected_grade, tail_probability) of the documents worth keeping: a tail probability of threshold or more."""
    return score(docs, fit(docs, labels, **params), at_least=at_least).filter(F.col("tail_probability") >= threshold)
