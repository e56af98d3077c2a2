"""Latent Dirichlet allocation by expectation maximisation with pseudo-counts, over (doc_id, term, n) or over packed documents.

Packed documents lie in chunks of CHUNK characters by a hash of their id. A chunk has words of its own, numbered from 0, and a row for each
document with the numbers and counts of its words. A sweep sends each chunk the weights of its words and makes all its steps there, so that what is
shuffled is a chunk's different words and no row for each word of each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import frequent_terms, term_counts, tokens  # noqa: F401
from ..functions.vectors import dot
from ..sources.tables import load_model, save_model, settled

TINY = 1e-100
#: Characters of a chunk of documents.
CHUNK = 32 << 20
#: Rows of packed documents: a chunk's words (at is the word's number, v has what is known of it), its documents (v has theta), or sums over documents (v).
WORD, DOC, SUMS = 0, 1, 2


def _each(k: int, make) -> list[Column]:
    return [make(i).alias(f"s{i}") for i in range(k)]


def _share(sums: list[Column], plus: float) -> Column:
    return F.array(*[s + plus for s in sums])


def _scaled(v: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return F.transform(v, lambda x: x / total)


def initial_topics(terms: DataFrame, topics: int) -> DataFrame:
    """(term, beta): weights made from hex digits of the term's MD5, each topic's summing to 1; the same in any engine."""
    digits = [(F.conv(F.substring(F.md5("term"), 1 + 4 * (i % 8), 4), 16, 10).cast("double") + 1 + i // 8) for i in range(topics)]
    raw = terms.select("term", *[d.alias(f"s{i}") for i, d in enumerate(digits)])
    totals = raw.agg(*[F.sum(f"s{i}").alias(f"t{i}") for i in range(topics)])
    return raw.crossJoin(F.broadcast(totals)).select("term", F.array(*[F.col(f"s{i}") / F.col(f"t{i}") for i in range(topics)]).alias("beta"))


def even(counts: DataFrame, topics: int, id_col: str = "doc_id") -> DataFrame:
    return counts.select(id_col).distinct().select(id_col, F.array(*[F.lit(1.0 / topics)] * topics).alias("theta"))


def _joined(counts: DataFrame, theta: DataFrame, beta: DataFrame, id_col: str) -> DataFrame:
    """Counts with theta, beta and r, the count by its probability."""
    j = counts.join(theta, id_col).join(beta, "term")
    return j.withColumn("r", F.col("n") / F.greatest(dot(F.col("theta"), F.col("beta")), F.lit(TINY)))


def e_step(counts: DataFrame, theta: DataFrame, beta: DataFrame, topics: int, alpha: float, id_col: str = "doc_id") -> DataFrame:
    """(id, theta) after one step: alpha and theta by what its words say, to a sum of 1."""
    sums = _joined(counts, theta, beta, id_col).groupBy(id_col).agg(F.first("theta").alias("theta"), *_each(topics, lambda i: F.sum(F.col("r") * F.col("beta")[i])))
    return sums.select(id_col, _scaled(_share([F.col("theta")[i] * F.col(f"s{i}") for i in range(topics)], alpha)).alias("theta"))


def m_step(counts: DataFrame, theta: DataFrame, beta: DataFrame, topics: int, eta: float, id_col: str = "doc_id", scale: float = 1.0) -> DataFrame:
    """(term, beta) after one step; every term of beta stays, with eta at least. scale multiplies eta and counts alike before the sums become 1."""
    sums = _joined(counts, theta, beta, id_col).groupBy("term").agg(*_each(topics, lambda i: F.sum(F.col("r") * F.col("theta")[i])))
    raw = beta.join(sums, "term", "left").select("term", *[(F.lit(scale) * (F.lit(eta) + F.col("beta")[i] * F.coalesce(F.col(f"s{i}"), F.lit(0.0)))).alias(f"b{i}") for i in range(topics)])
    return _columns_to_one(raw, topics)


def _columns_to_one(raw: DataFrame, topics: int) -> DataFrame:
    totals = raw.agg(*[F.sum(f"b{i}").alias(f"t{i}") for i in range(topics)])
    return raw.crossJoin(F.broadcast(totals)).select("term", F.array(*[F.col(f"b{i}") / F.col(f"t{i}") for i in range(topics)]).alias("beta"))


def perplexity(counts: DataFrame, theta: DataFrame, beta: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row: exp of minus the mean log probability of a word."""
    p = F.greatest(dot(F.col("theta"), F.col("beta")), F.lit(TINY))
    j = counts.join(theta, id_col).join(beta, "term")
    return j.agg(F.exp(-F.sum(F.col("n") * F.ln(p)) / F.sum("n")).alias("perplexity"))


def _kinds(id_kind: str) -> str:
    return f"chunk int, kind int, at int, term string, doc_id {id_kind}, idx array<int>, n array<int>, v array<double>"


_NAMES = ["chunk", "kind", "at", "term", "doc_id", "idx", "n", "v"]


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _rows(chunk: int, kind: int, size: int, **columns: pa.Array) -> pa.RecordBatch:
    empty = {"at": pa.int32(), "term": pa.string(), "doc_id": pa.null(), "idx": pa.list_(pa.int32()), "n": pa.list_(pa.int32()), "v": pa.list_(pa.float64())}
    filled = [columns.get(c, pa.nulls(size, columns.get("none", pa.nulls(0)).type if c == "doc_id" else t)) for c, t in empty.items()]
    return pa.record_batch([pa.array(np.full(size, chunk, np.int32)), pa.array(np.full(size, kind, np.int32)), *filled], _NAMES)


def _matrix(v: np.ndarray) -> pa.Array:
    return _lists(np.arange(len(v) + 1) * v.shape[1], np.ascontiguousarray(v).ravel(), pa.float64())


def _runs(batches: Iterator[pa.RecordBatch], marks: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of the batches in which the first columns, whole numbers, stay the same."""
    for b in batches:
        if b.num_rows:
            m = np.stack([b.column(k).to_numpy() for k in range(marks)], 1)
            cuts = np.flatnonzero((m[1:] != m[:-1]).any(1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(m)], strict=True):
                yield tuple(m[s].tolist()), b.slice(s, e - s)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(words, documents, number of chunks): every word of each chunk with its number of documents there, and every document; rows of one id are one document."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows, chars = docs.agg(F.count("*"), F.sum(F.length(text_col))).first()
    chunks = max(1, -(-(chars or 0) // CHUNK), min(3 * cores, -(-rows // 256)))
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.pmod(F.xxhash64(id_col), F.lit(chunks)).cast("int").alias("chunk"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    placed = named.repartition(chunks, "chunk").sortWithinPartitions("chunk").select("chunk", "doc_id", tokens(F.col("text")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(chunk: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column("doc_id").combine_chunks().dictionary_encode("encode")
            tokens = t.column("tokens").combine_chunks()
            words = tokens.flatten().dictionary_encode()
            lengths, names = tokens.value_lengths().to_numpy(), words.dictionary
            width = max(1, len(names))
            key, n = np.unique(np.repeat(ids.indices.to_numpy().astype(np.int64), lengths) * width + words.indices.to_numpy(), return_counts=True)
            doc, idx = key // width, (key % width).astype(np.int32)
            df = np.bincount(idx, minlength=len(names)).astype(float)
            none = ids.dictionary.slice(0, 0)
            yield _rows(chunk, WORD, len(names), at=pa.array(np.arange(len(names), dtype=np.int32)), term=names, v=_matrix(df[:, None]), none=none)
            cuts = np.searchsorted(doc, np.arange(len(ids.dictionary) + 1))
            for a in range(0, len(ids.dictionary), 2000):
                b = min(a + 2000, len(ids.dictionary))
                part = slice(cuts[a], cuts[b])
                at = cuts[a : b + 1] - cuts[a]
                yield _rows(chunk, DOC, b - a, doc_id=ids.dictionary.slice(a, b - a), idx=_lists(at, idx[part], pa.int32()), n=_lists(at, n[part].astype(np.int32), pa.int32()))

        now, held = None, []
        for mark, part in _runs(batches, 1):
            if held and mark != now:
                yield from packed(now[0], held)
                held = []
            now = mark
            held.append(part)
        if held:
            yield from packed(now[0], held)

    got = settled(placed.mapInArrow(run, _kinds(kind)), "packed")
    return got.filter(F.col("kind") == WORD), got.filter(F.col("kind") == DOC), chunks


def vocabulary(words: DataFrame, docs: int, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """(term) of the terms in min_df documents or more, and in no larger share of so many documents than max_df."""
    df = words.groupBy("term").agg(F.sum(F.col("v")[0]).alias("df"))
    return df.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * docs)).select("term")


def _step(theta: np.ndarray, b: np.ndarray, n: np.ndarray, doc: np.ndarray, first: np.ndarray, some: np.ndarray, alpha: float) -> np.ndarray:
    r = n / np.maximum(np.einsum("ij,ij->i", theta[doc], b), TINY)
    new = theta.copy()
    new[some] = alpha + theta[some] * np.add.reduceat(r[:, None] * b, first, axis=0)
    return new / new.sum(1, keepdims=True)


def sweep(documents: DataFrame, words: DataFrame, beta: DataFrame, chunks: int, topics: int, alpha: float, steps: int = 1, again: bool = False, sums: bool = False, fit: bool = False) -> DataFrame:
    """Rows as in packed documents: each document with its theta after so many steps, from its v or even shares, at is its number of different words of beta.

    again keeps the documents' words, as far as beta has them, for another sweep. With sums there is a row for each of a chunk's words with what its
    documents say of it for each topic, with fit a row with the sums of n * log probability and of n.
    """
    slices = words.select("chunk", "kind", "at", "term", "doc_id", "idx", "n").join(beta.select("term", F.col("beta").alias("v")), "term").select(*_NAMES)
    placed = slices.union(documents.select(*_NAMES)).repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, terms, b, known, total = None, [], None, None, None

        def begun() -> None:
            nonlocal b, known, total
            if terms:
                t = pa.Table.from_batches(terms).combine_chunks()
                at = t.column("at").to_numpy()
                b = np.zeros((at.max() + 1, topics))
                b[at] = t.column("v").chunk(0).flatten().to_numpy().reshape(-1, topics)
                known = np.zeros(len(b), bool)
                known[at] = True
            else:
                b, known = np.zeros((1, topics)), np.zeros(1, bool)
            total = np.zeros_like(b) if sums else None

        def ended() -> Iterator[pa.RecordBatch]:
            if sums and terms and total is not None:
                for t in terms:
                    yield _rows(chunk, WORD, t.num_rows, at=t.column(2), term=t.column(3), v=_matrix(total[t.column(2).to_numpy()]), none=t.column(4).slice(0, 0))

        def documents(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lists, counts = part.column(5), part.column(6)
            idx, n, size = lists.flatten().to_numpy(), counts.flatten().to_numpy(), part.num_rows
            doc = np.repeat(np.arange(size), lists.value_lengths().to_numpy())
            keep = idx < len(known)
            keep[keep] = known[idx[keep]]
            idx, n, doc = idx[keep], n[keep], doc[keep]
            cuts = np.searchsorted(doc, np.arange(size + 1))
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            given = part.column(7)
            theta = np.full((size, topics), 1 / topics) if given.null_count == size else given.flatten().to_numpy().reshape(-1, topics).copy()
            if len(idx):
                gathered, first = b[idx], cuts[some]
                for _ in range(steps):
                    theta = _step(theta, gathered, n, doc, first, some, alpha)
                    theta[cuts[1:] == cuts[:-1]] = 1 / topics
                if sums or fit:
                    own = theta[doc]
                    p = np.maximum(np.einsum("ij,ij->i", own, gathered), TINY)
                if sums:
                    for k in range(topics):
                        total[:, k] += np.bincount(idx, n / p * own[:, k], len(total))
                if fit:
                    yield _rows(chunk, SUMS, 1, v=_matrix(np.array([[(n * np.log(p)).sum(), float(n.sum())]])), none=part.column(4).slice(0, 0))
            more = {"idx": _lists(cuts, idx, pa.int32()), "n": _lists(cuts, n, pa.int32())} if again else {}
            yield _rows(chunk, DOC, size, at=pa.array((cuts[1:] - cuts[:-1]).astype(np.int32)), doc_id=part.column(4), v=_matrix(theta), **more)

        for (at, kind), part in _runs(batches, 2):
            if at != chunk:
                yield from ended()
                chunk, terms, b, total = at, [], None, None
            if kind == WORD:
                terms.append(part)
                continue
            if b is None:
                begun()
            # Few documents at once, so that what is made of their words is small.
            for s in range(0, part.num_rows, 1000):
                yield from documents(part.slice(s, 1000))
        yield from ended()

    return placed.mapInArrow(run, _kinds(documents.schema["doc_id"].dataType.simpleString()))


def _summed(swept: DataFrame, topics: int) -> DataFrame:
    """(term, s0, s1, ...) of a sweep with sums."""
    return swept.filter(F.col("kind") == WORD).groupBy("term").agg(*_each(topics, lambda i: F.sum(F.col("v")[i])))


def m_step_of(swept: DataFrame, beta: DataFrame, topics: int, eta: float) -> DataFrame:
    """(term, beta) as of m_step, from a sweep with sums."""
    raw = beta.join(_summed(swept, topics), "term", "left").select("term", *[(F.lit(eta) + F.col("beta")[i] * F.coalesce(F.col(f"s{i}"), F.lit(0.0))).alias(f"b{i}") for i in range(topics)])
    return _columns_to_one(raw, topics)


def thetas(swept: DataFrame) -> DataFrame:
    """(doc_id, theta, words) of a sweep, with each document's number of different words of beta."""
    return swept.filter(F.col("kind") == DOC).select("doc_id", F.col("v").alias("theta"), F.col("at").alias("words"))


class Lda:
    """fit, transform, topics, save and load. Batch mode goes over all counts in each iteration; online mode over hash slices of the documents."""

    def __init__(self, topics: int = 10, iterations: int = 30, alpha: float | None = None, eta: float = 0.01, method: str = "auto", batch_size: int = 512, memory_limit_gb: float = 64, min_df: int = 2, max_df: float = 0.95):
        self.topics, self.iterations, self.eta, self.method, self.batch = topics, iterations, eta, method, batch_size
        self.alpha = 1.0 / topics if alpha is None else alpha
        self.limit, self.min_df, self.max_df = memory_limit_gb, min_df, max_df
        self.beta: DataFrame | None = None
        self.theta: DataFrame | None = None
        self.docs: DataFrame | None = None

    def _need(self) -> DataFrame:
        if self.beta is None:
            raise ValueError("fit comes first")
        return self.beta

    def fit(self, docs: DataFrame) -> Lda:
        words, packed, chunks = pack(docs)
        terms = settled(vocabulary(words, docs.count(), self.min_df, self.max_df), "terms")
        words = settled(words.join(terms, "term", "left_semi").select(*_NAMES), "words")
        # Counts are held as such and no matrix of documents and terms is made, so their bytes decide.
        batch = self.method == "batch" or (self.method == "auto" and (packed.agg(F.sum(F.size("idx"))).first()[0] or 0) * 12 / 1e9 < self.limit)
        beta = settled(initial_topics(terms, self.topics), "beta")
        if batch:
            for _ in range(self.iterations):
                packed = settled(sweep(packed, words, beta, chunks, self.topics, self.alpha, again=True, sums=True), "swept")
                beta = settled(m_step_of(packed, beta, self.topics, self.eta), "beta")
                packed = packed.filter(F.col("kind") == DOC)
            # Shares as of the last sweep, from before the last step of the topics.
            flat = F.array(*[F.lit(1.0 / self.topics)] * self.topics)
            self.beta, self.theta = beta, packed.select("doc_id", F.coalesce("v", flat).alias("theta"))
            return self
        packed = settled(sweep(packed, words, beta, chunks, self.topics, self.alpha, steps=0, again=True), "known").filter(F.col("at") > 0).withColumn("v", F.lit(None).cast("array<double>"))
        n = packed.count()
        slices, step = max(1, -(-n // self.batch)), 0
        lam = beta
        for epoch in range(self.iterations):
            for k in range(slices):
                part = packed.filter(F.pmod(F.xxhash64("doc_id", F.lit(epoch)), F.lit(slices)) == k)
                here = part.count()
                if not here:
                    continue
                step += 1
                sums = _summed(sweep(part, words, beta, chunks, self.topics, self.alpha, steps=5, sums=True), self.topics)
                rho, scale = (64 + step) ** -0.7, n / here
                both = lam.withColumnRenamed("beta", "lam").join(beta, "term").join(sums, "term", "left")
                lam = settled(both.select("term", F.array(*[(1 - rho) * F.col("lam")[i] + rho * scale * (self.eta + F.col("beta")[i] * F.coalesce(F.col(f"s{i}"), F.lit(0.0))) for i in range(self.topics)]).alias("beta")), "lambda")
                beta = settled(_columns_to_one(lam.select("term", *[F.col("beta")[i].alias(f"b{i}") for i in range(self.topics)]), self.topics), "beta")
        self.beta = beta
        self.theta, self.docs = None, docs
        return self

    def transform(self, docs: DataFrame, steps: int = 30) -> DataFrame:
        """(doc_id, theta) by so many steps with fixed topics; unknown words don't count, and a document without known ones has even shares."""
        beta = self._need()
        words, packed, chunks = pack(docs)
        return thetas(sweep(packed, words, beta, chunks, self.topics, self.alpha, steps)).select("doc_id", "theta")

    def fit_transform(self, docs: DataFrame) -> DataFrame:
        return self.fit(docs).doc_topics()

    def doc_topics(self) -> DataFrame:
        if self.theta is None:
            if self.docs is None:
                raise ValueError("fit comes first")
            # Online fitting keeps no shares; they are made when they are asked for.
            self.theta = self.transform(self.docs)
        return self.theta

    def components(self) -> DataFrame:
        return self._need().select("term", F.transform("beta", lambda b: b * 1000).alias("weights"))

    def topic_words(self, n: int = 10, digits: int = 8) -> DataFrame:
        """(topic, rank, term, weight), by the rounded weight and then the term."""
        from pyspark.sql import Window

        long = self._need().select("term", F.posexplode("beta").alias("topic", "w")).withColumn("weight", F.round("w", digits))
        best = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
        return long.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select("topic", "rank", "term", "weight")

    def described(self, n: int = 10) -> list[str]:
        rows = self.topic_words(n).orderBy("topic", "rank").collect()
        return [f"Topic {t}: " + " · ".join(r.term for r in rows if r.topic == t) for t in sorted({r.topic for r in rows})]

    def save(self, path: str) -> None:
        save_model(path, {"beta": self._need()}, {"topics": self.topics, "alpha": self.alpha, "eta": self.eta, "min_df": self.min_df, "max_df": self.max_df})

    @classmethod
    def load(cls, spark, path: str) -> Lda:
        parts, about = load_model(spark, path, ["beta"])
        model = cls(about["topics"], alpha=about["alpha"], eta=about["eta"], min_df=about["min_df"], max_df=about["max_df"])
        model.beta = parts["beta"]
        return model
