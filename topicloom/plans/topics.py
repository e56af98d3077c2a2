"""The whole topic model: embed, reduce, cluster, weigh, represent, and put outliers right. Each stage can be replaced."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import term_counts, tokens
from ..operators import ctfidf, hdbscan, keywords, outliers, reduce
from ..sources.tables import settled


def hashing_embedder(dims: int = 64) -> Callable[[DataFrame, str, str], DataFrame]:
    """An embedder without a model: words' hashes, signed, in dims places, to length 1."""

    def embed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        h = docs.select(id_col, F.transform(tokens(F.col(text_col)), lambda w: F.xxhash64(w)).alias("h"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(1)
                values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                x = np.zeros((len(lists), dims))
                np.add.at(x, (rows, (values % np.uint64(dims)).astype(int)), np.where((values >> np.uint64(40)) & np.uint64(1), 1.0, -1.0))
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims), pa.array(x.ravel().astype(np.float32)))], [id_col, "embedding"])

        return h.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, embedding array<float>")

    return embed


@dataclass
class TopicModel:
    """fit_transform gives (doc_id, topic, probability); info, words and centroids then describe the topics."""

    embedder: Callable[[DataFrame, str, str], DataFrame] = field(default_factory=hashing_embedder)
    components: int = 5
    reducer: Callable[..., DataFrame] = reduce.pca
    min_cluster_size: int = 15
    min_samples: int | None = None
    top_n_words: int = 10
    ngrams: int = 1
    weighting: ctfidf.ClassTfidf = field(default_factory=ctfidf.ClassTfidf)
    representation: str = "ctfidf"
    diversity: float = 0.3

    def fit_transform(self, docs: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
        """docs has (doc_id, text); embeddings (doc_id, embedding) spares the embedding stage."""
        self.docs = docs.select("doc_id", "text")
        self.embeddings = settled(embeddings.select("doc_id", "embedding") if embeddings is not None else self.embedder(self.docs, "doc_id", "text"), "embeddings")
        low = settled(self.reducer(self.embeddings, self.components, id_col="doc_id", vec_col="embedding"), "reduced")
        found = hdbscan.cluster(low, self.min_cluster_size, self.min_samples, "doc_id", "vec")
        self.topics = settled(found.select(F.col("id").alias("doc_id"), F.col("label").alias("topic"), "probability"), "topics")
        self._describe()
        return self.topics

    def _describe(self) -> None:
        counts = term_counts(self.docs.join(self.topics.filter("topic >= 0"), "doc_id"), ["topic"], ngrams=self.ngrams).withColumnRenamed("topic", "class")
        self.scores = settled(self.weighting.fit_transform(settled(counts, "counts")), "scores")

    def words(self) -> DataFrame:
        """(topic, rank, word, score) by the chosen representation."""
        plain = ctfidf.top_terms(self.scores, self.top_n_words).select(F.col("class").alias("topic"), "rank", F.col("term").alias("word"), "score")
        if self.representation == "ctfidf":
            return plain
        if self.representation not in ("nearest", "diverse"):
            warnings.warn(f"no representation {self.representation!r}; c-TF-IDF words are given", stacklevel=2)
            return plain
        vectors = keywords.word_vectors(self.docs, self.embeddings)
        placed = self.embeddings.join(self.topics, "doc_id")
        return keywords.keywords(placed, vectors, self.top_n_words) if self.representation == "nearest" else keywords.diverse_keywords(placed, vectors, self.top_n_words, self.diversity)

    def info(self) -> DataFrame:
        return self.topics.groupBy("topic").agg(F.count("*").alias("n"))

    def reduce_outliers(self, strategy: str = "embeddings", threshold: float = 0.0) -> DataFrame:
        """The topics with outliers put into their nearest ones; the words follow."""
        if strategy == "embeddings":
            found = outliers.by_embeddings(self.embeddings.join(self.topics, "doc_id"), threshold)
        elif strategy == "ctfidf":
            ids = self.topics.filter("topic = -1").select("doc_id")
            counts = term_counts(self.docs.join(ids, "doc_id", "left_semi"), ["doc_id"])
            found = outliers.by_ctfidf(counts, self.scores.withColumnRenamed("class", "topic"), threshold, ids=ids)
        else:
            raise ValueError("strategy is embeddings or ctfidf")
        self.topics = settled(outliers.merged(self.topics, found), "topics")
        self._describe()
        return self.topics
