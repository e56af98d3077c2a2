"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A word also counts by its beginnings, which are the same in its inflected forms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, list_array, lists, mix, small_batches

BITS = 20
#: Bound of the labelled rows that a fit uses; they are drawn by the hash of their id.
MAX_LABELLED = 12_000
#: Letters of a word's beginnings.
STEMS = (3, 4, 6)
_EACH = 1 + len(STEMS)


@dataclass
class Model:
    """Non-zero weights only, so that it stays small enough to send to every executor."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = BITS

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.index] = self.weight
        return w

    def probabilities(self, r: np.ndarray, f: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each row; a feature counts once, a row of size 0 has 0."""
        hit = weights[f] != 0
        key = np.unique(r[hit] << self.bits | f[hit])
        total = np.bincount(key >> self.bits, weights[key & ((1 << self.bits) - 1)], len(sizes)) + self.bias
        return np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(total, -35, 35))), 0.0)


def _hashes(text: Column) -> Column:
    """64-bit hashes of each lower-case word of a text and of its beginnings, one after another; empty for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.array(F.xxhash64(w), *[F.xxhash64(F.substring(w, 1, n)) for n in STEMS])))


def features(hashes: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, its beginnings, pairs of neighbours and pairs with one word skipped; repeats included."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) // _EACH)
    each = hashes.view(np.uint64).reshape(-1, _EACH)
    w = each[:, 0]
    shift = np.uint64(64 - bits)
    out_rows, out = [rows], [mix(w) >> shift]
    with np.errstate(over="ignore"):
        for k in range(1, _EACH):
            out.append(mix(each[:, k] * np.uint64(2 * k + 1) + np.uint64(k)) >> shift)
            out_rows.append(rows)
        for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            if len(w) > gap:
                same = rows[:-gap] == rows[gap:]
                pair = mix(w[:-gap] * np.uint64(salt) + (w[gap:] ^ np.uint64(salt >> 7)))
                out.append((pair >> shift)[same])
                out_rows.append(rows[:-gap][same])
    return np.concatenate(out_rows), np.concatenate(out).astype(np.int64)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 5, seed: int = 7) -> Model:
    """Per-coordinate FTRL-proximal over present features. With one class or no rows all weights are 0 and only the bias is set."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 9.0 if len(labels) and labels.max() else -9.0, bits)
    bz, bn, rng = 0.0, 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            x = examples[i]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) > l1, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2), 0.0)
            b = -bz / ((beta + np.sqrt(bn)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - labels[i]
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * b
            bn += g * g
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    keep = np.flatnonzero(w)
    return Model(keep, w[keep].astype(np.float32), float(-bz / ((beta + np.sqrt(bn)) / alpha)), bits)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, **params) -> Model:
    """Fit on at most max_labelled labelled rows.

    Rows with a null id or label are not used; an id with several labels has the
    greatest; an id whose text is null or empty is a row without features.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna()
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id", F.lit(7)), "_id").limit(max_labelled)
    )
    # At most max_labelled rows of two numbers, so it may be broadcast.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_id").select("_id", "_y", _hashes(F.col("_t")).alias("_w"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, offsets = lists(b.column("_w"))
            r, f = features(words, offsets)
            key = np.unique(r << BITS | f)
            bounds = np.searchsorted(key >> BITS, np.arange(b.num_rows + 1))
            yield pa.record_batch([b.column("_id").cast(pa.int64()), b.column("_y"), list_array((key & ((1 << BITS) - 1)).astype(np.int32), bounds)], ["_id", "_y", "_f"])

    got = rows.mapInArrow(hashed, "_id long, _y int, _f array<int>").toArrow().combine_chunks()
    if got.num_rows == 0:
        return ftrl([], np.zeros(0), **params)
    order = np.argsort(got.column("_id").to_numpy(), kind="stable")
    values, offsets = lists(got.column("_f").chunk(0))
    y = (got.column("_y").to_numpy() > 0).astype(np.float64)[order]
    return ftrl([values[offsets[i] : offsets[i + 1]] for i in order], y, **params)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxicity): the probability for every row; null and empty texts have 0.0. Repeated rows are scored each."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        weights = m.dense()
        for b in batches:
            words, offsets = lists(b.column("_w"))
            r, f = features(words, offsets)
            p = m.probabilities(r, f, weights, np.diff(offsets))
            yield pa.record_batch([b.column(0), pa.array(p)], [id_col, "toxicity"])

    return docs.select(F.col(id_col), _hashes(F.col(text_col)).alias("_w")).mapInArrow(scored, f"`{id_col}` {id_type}, toxicity double")


def toxic_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **params) -> DataFrame:
    """(doc_id, toxicity) of the documents at or above the threshold."""
    return score(docs, fit(docs, labels, **params)).filter(F.col("toxicity") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **params) -> DataFrame:
    """The documents below the threshold, with all their columns, in one pass.

    Documents without text and those with a null id stay. Extra columns may have any name.
    """
    model = fit(docs, labels, **params)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        weights = m.dense()
        for b in batches:
            words, offsets = lists(b.column(b.num_columns - 1))
            r, f = features(words, offsets)
            p = m.probabilities(r, f, weights, np.diff(offsets))
            yield b.filter(pa.array(p < threshold)).select(list(range(b.num_columns - 1)))

    return plain.select("*", _hashes(F.col(text)).alias("_w")).mapInArrow(kept, plain.schema).toDF(*names)
