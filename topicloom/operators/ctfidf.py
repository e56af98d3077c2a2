"""Class-based TF-IDF over (class, term, n) counts; an absent row is a count of 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit(counts: DataFrame, classes: int | None = None, bm25: bool = False, whole_average: bool = True) -> DataFrame:
    """(term, total, idf) with the total count of a term and the mean words of a class, cut to a whole number unless whole_average is off.

    classes counts those without any word too, which the counts can't show.
    """
    totals = counts.groupBy("term").agg(F.sum("n").alias("total"))
    number = F.lit(classes) if classes is not None else F.count_distinct("class")
    average = counts.agg((F.sum("n") / number).alias("a")).select((F.floor("a") if whole_average else F.col("a")).cast("double").alias("avg"))
    idf = F.ln(1 + (F.col("avg") - F.col("total") + 0.5) / (F.col("total") + 0.5)) if bm25 else F.ln(F.col("avg") / F.col("total") + 1)
    return totals.crossJoin(F.broadcast(average)).select("term", "total", idf.alias("idf"))


def transform(counts: DataFrame, idf: DataFrame, reduce_frequent: bool = False, multiplier: DataFrame | None = None, l2: bool = False) -> DataFrame:
    """(class, term, score): share of the class's words, by idf; terms that weren't fitted have no score.

    reduce_frequent takes the share's square root; multiplier has (term, multiplier), 1 where there is none.
    """
    share = F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("class")), F.lit(1e-12))
    weight = F.col("idf")
    if multiplier is not None:
        idf = idf.join(multiplier, "term", "left").withColumn("idf", F.col("idf") * F.coalesce("multiplier", F.lit(1.0)))
    scored = counts.withColumn("tf", F.sqrt(share) if reduce_frequent else share).join(idf.select("term", "idf"), "term").select("class", "term", (F.col("tf") * weight).alias("score"))
    if l2:
        length = F.sqrt(F.sum(F.col("score") * F.col("score")).over(Window.partitionBy("class")))
        scored = scored.withColumn("score", F.col("score") / F.greatest(length, F.lit(1e-12)))
    return scored


class ClassTfidf:
    """fit, transform and fit_transform with the weighting options as state."""

    def __init__(self, reduce_frequent_words: bool = False, bm25_weighting: bool = False, seed_words: list[str] | None = None, seed_multiplier: float = 2.0):
        self.reduce, self.bm25 = reduce_frequent_words, bm25_weighting
        self.seeds, self.seed_multiplier = seed_words, seed_multiplier
        self.idf: DataFrame | None = None
        self.multiplier: DataFrame | None = None

    def fit(self, counts: DataFrame, multiplier: DataFrame | None = None, classes: int | None = None) -> ClassTfidf:
        if multiplier is None and self.seeds:
            multiplier = counts.sparkSession.createDataFrame([(w, float(self.seed_multiplier)) for w in sorted(set(self.seeds))], "term string, multiplier double")
        self.idf, self.multiplier = fit(counts, classes, self.bm25), multiplier
        return self

    def transform(self, counts: DataFrame, multiplier: DataFrame | None = None) -> DataFrame:
        if self.idf is None:
            raise RuntimeError("fit comes before transform")
        return transform(counts, self.idf, self.reduce, multiplier if multiplier is not None else self.multiplier)

    def fit_transform(self, counts: DataFrame, multiplier: DataFrame | None = None) -> DataFrame:
        return self.fit(counts, multiplier).transform(counts)


def top_terms(scores: DataFrame, n: int = 10, digits: int = 8) -> DataFrame:
    """(class, rank, term, score) of the n best; by the rounded score, then the term."""
    s = scores.withColumn("score", F.round("score", digits))
    best = Window.partitionBy("class").orderBy(F.desc("score"), "term")
    return s.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n).select("class", "rank", "term", "score")


def bm25_documents(counts: DataFrame, documents: DataFrame, id_col: str = "doc_id", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, term, score) for every term of every document; a term's frequency is its total count."""
    size = documents.agg(F.count("*").alias("docs"))
    lengths = F.sum("n").over(Window.partitionBy(id_col))
    totals = counts.groupBy("term").agg(F.greatest(F.sum("n").cast("double"), F.lit(0.5)).alias("df"))
    average = counts.agg(F.sum("n").alias("words")).crossJoin(size).select((F.col("words") / F.col("docs")).alias("avgdl"), "docs")
    rows = counts.withColumn("dl", lengths).join(totals, "term").crossJoin(F.broadcast(average))
    idf = F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.select(id_col, "term", (tf * idf).alias("score"))
