"""Vectors as arrays of doubles, and blocks of them in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a matrix that may go to every executor; beyond it the join is left to Spark.
MOST_SENT = 128 << 20


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mean_vectors(df: DataFrame, keys: list[str], vec_col: str) -> DataFrame:
    """(keys..., vec, n): the mean vector of each group, summed in part before the shuffle."""
    return df.groupBy(*keys).agg(Summarizer.mean(array_to_vector(doubles(F.col(vec_col)))).alias("m"), F.count("*").alias("n")).select(*keys, vector_to_array("m").alias("vec"), "n")


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, of one length, as a 2-D array."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(float) if len(column) else np.zeros((0, 0))


def cosines(items: DataFrame, item_cols: list[str], vec_col: str, others: DataFrame, other_cols: list[str], eps: float = 1e-9) -> DataFrame:
    """(item_cols..., other_cols..., sim): cosine of each item with each of the others, norms of eps at least.

    The others (topics, bins) are few: they go to every executor as one matrix as
    long as it has MOST_SENT bytes or fewer, and are cross-joined otherwise.
    """
    n, d = others.agg(F.count("*"), F.max(F.size("vec"))).first()
    left = items.select(*item_cols, doubles(F.col(vec_col)).alias("_v"))
    if n * (d or 0) * 8 > MOST_SENT:
        both = left.crossJoin(others.select(*other_cols, F.col("vec").alias("_w")))
        sim = dot(F.col("_v"), F.col("_w")) / F.greatest(norm(F.col("_v")), F.lit(eps)) / F.greatest(norm(F.col("_w")), F.lit(eps))
        return both.select(*item_cols, *other_cols, sim.alias("sim"))
    few = others.select(*other_cols, "vec").orderBy(*other_cols).toArrow().combine_chunks()
    m = matrix(few.column("vec").chunk(0)) if few.num_rows else np.zeros((0, d or 0))
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), eps)
    sent = items.sparkSession.sparkContext.broadcast((m, few.drop_columns("vec")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, names = sent.value
        for b in batches:
            if not b.num_rows or not len(m):
                continue
            x = matrix(b.column(b.num_columns - 1))
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), eps)
            rows, which = np.repeat(np.arange(len(x)), len(m)), np.tile(np.arange(len(m)), len(x))
            cols = [b.column(i).take(pa.array(rows)) for i in range(b.num_columns - 1)]
            cols += [names.column(c).combine_chunks().take(pa.array(which)) for c in other_cols]
            yield pa.record_batch([*cols, pa.array((x @ m.T).ravel())], [*item_cols, *other_cols, "sim"])

    kinds = ", ".join([*[f"`{c}` {items.schema[c].dataType.simpleString()}" for c in item_cols], *[f"`{c}` {others.schema[c].dataType.simpleString()}" for c in other_cols], "sim double"])
    return left.mapInArrow(compare, kinds)


def stabilize(df: DataFrame, vec_col: str, out_col: str, most: float = 15.0, clip: float = 20.0) -> DataFrame:
    """Vectors longer than most are scaled down to it; then coordinates are clipped."""
    v = doubles(F.col(vec_col))
    scale = F.least(F.lit(most) / F.sqrt(dot(v, v) + 1e-8), F.lit(1.0))
    return df.withColumn(out_col, F.transform(v, lambda x: F.greatest(F.least(x * scale, F.lit(clip)), F.lit(-clip))))
