"""Topic keywords from embeddings: nearest words to a centroid, and maximal marginal relevance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosines, doubles, matrix, mean_vectors


def centroids(docs: DataFrame, topic_col: str = "topic", vec_col: str = "embedding") -> DataFrame:
    """(topic, vec, n) of the real topics; -1 marks outliers."""
    return mean_vectors(docs.filter(F.col(topic_col) >= 0).withColumnRenamed(topic_col, "topic"), ["topic"], vec_col)


def keywords(docs: DataFrame, words: DataFrame, top_n: int = 10, digits: int = 6) -> DataFrame:
    """(topic, rank, word, score): words whose vector is nearest to the topic's centroid; ties by the word."""
    sims = cosines(words, ["word"], "vec", centroids(docs), ["topic"]).withColumn("score", F.round(F.col("sim"), digits) + 0.0)
    best = Window.partitionBy("topic").orderBy(F.desc("score"), "word")
    return sims.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_n).select("topic", "rank", "word", "score")


def relevant(score: np.ndarray, vectors: np.ndarray, top_n: int, diversity: float) -> list[int]:
    """Greedy picks, the best first; each next one has the most of (1 - diversity) * score - diversity * its greatest cosine with a pick. At least one."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    picks, left = [0], list(range(1, len(score)))
    near = unit @ unit[0]
    while len(picks) < min(top_n, len(score)):
        value = np.round((1 - diversity) * score[left] - diversity * near[left], 6)
        k = left.pop(int(np.argmax(value)))
        picks.append(k)
        near = np.maximum(near, unit @ unit[k])
    return picks


def diverse_keywords(docs: DataFrame, words: DataFrame, top_n: int = 10, diversity: float = 0.3, candidates: int = 50) -> DataFrame:
    """(topic, rank, word, score) in the order of the picks; the score is the cosine with the topic."""
    best = keywords(docs, words, candidates).join(words.select("word", doubles(F.col("vec")).alias("vec")), "word")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        picks = relevant(pdf["score"].to_numpy(), np.stack(pdf["vec"].to_numpy()), top_n, diversity)
        out = pdf.iloc[picks][["topic", "rank", "word", "score"]].copy()
        out["rank"] = np.arange(1, len(picks) + 1, dtype=np.int32)
        return out

    return best.groupBy("topic").applyInPandas(choose, best.select("topic", "rank", "word", "score").schema)


def word_vectors(docs: DataFrame, vectors: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, vec): mean vector of the documents that have the word; a stand-in where there is no model to embed words.

    Words and vectors meet in Arrow batches, which give a sum for each of their words; no row is made for a word of a document.
    """
    from ..functions.text import tokens

    has = docs.join(vectors.filter("embedding is not null"), id_col).select(F.array_distinct(tokens(F.col(text_col))).alias("words"), doubles(F.col("embedding")).alias("vec"))

    def rows(words: pa.Array, sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([words, pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1]), pa.array(np.ascontiguousarray(sums).ravel())), pa.array(n)], ["word", "vec", "n"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).flatten().dictionary_encode()
            if len(words):
                codes, at = words.indices.to_numpy(), np.repeat(np.arange(b.num_rows), b.column(0).value_lengths().to_numpy())
                x = np.ascontiguousarray(matrix(b.column(1)).T)
                size = len(words.dictionary)
                yield rows(words.dictionary, np.stack([np.bincount(codes, v[at], size) for v in x], 1), np.bincount(codes, minlength=size).astype(np.int64))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Means of words from their sums in sorted order; a word may go on in the next batch."""
        last: tuple[pa.Array, np.ndarray, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            words, x, n = b.column(0), matrix(b.column(1)), b.column(2).to_numpy()
            if last is not None:
                words, x, n = pa.concat_arrays([last[0], words]), np.concatenate([last[1], x]), np.concatenate([last[2], n])
            code = words.dictionary_encode().indices.to_numpy()
            first = np.flatnonzero(np.diff(code, prepend=-1))
            words, x, n = words.take(pa.array(first)), np.add.reduceat(x, first), np.add.reduceat(n, first)
            last = words.slice(len(first) - 1), x[-1:], n[-1:]
            if len(first) > 1:
                yield rows(words.slice(0, len(first) - 1), x[:-1] / n[:-1, None], n[:-1])
        if last is not None:
            yield rows(last[0], last[1] / last[2][:, None], last[2])

    kinds = "word string, vec array<double>, n long"
    return has.mapInArrow(partial, kinds).repartition("word").sortWithinPartitions("word").mapInArrow(whole, kinds).select("word", "vec")
