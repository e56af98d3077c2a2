"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import settled, shared_folder, spread

#: One run of letters, digits and underscores is a word, in Java's regular expressions and DuckDB's.
WORD_BREAK = r"[^\p{L}\p{N}_]+"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: The same rows from a table in the shared folder: the lineage ends there and executors may be lost.
written = settled


def id_kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that is connected to each id of the edges (a, b).

    Labels of neighbours spread and are followed to their own labels in each
    round, whose result is written, so that no lineage grows.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        better = labels.join(near, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        up = better.select(F.col("id").alias("root"), F.col("root").alias("up"))
        moved = written(better.join(up, "root").select("id", F.col("up").alias("root"), (F.col("up") != F.col("was")).alias("moved")), "labels")
        labels = moved.select("id", "root")
        if moved.filter("moved").isEmpty():
            return labels


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds, since a text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words of a text, in order; empty for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of an Arrow list column without nulls inside."""
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    return values, (offsets - offsets[0]).astype(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), applied in place of a hash family member."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; its rows over all cores where the files have fewer splits than that, as a single small file has."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
