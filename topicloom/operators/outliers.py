"""Outlier documents (topic -1) put into their nearest topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosines
from .keywords import centroids


def _best(sims: DataFrame, id_col: str, threshold: float, digits: int) -> DataFrame:
    """(id, topic, sim): the topic of the greatest rounded cosine, ties to the lower topic; -1 below the threshold."""
    s = sims.withColumn("sim", F.round("sim", digits) + 0.0)
    first = Window.partitionBy(id_col).orderBy(F.desc("sim"), "topic")
    top = s.withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    return top.select(id_col, F.when(F.col("sim") >= threshold, F.col("topic")).otherwise(F.lit(-1).cast(s.schema["topic"].dataType)).alias("topic"), "sim")


def by_embeddings(docs: DataFrame, threshold: float = 0.0, id_col: str = "doc_id", digits: int = 6) -> DataFrame:
    """(id, topic, sim) of the outliers of (id, topic, embedding). A threshold of 0 still needs a cosine of 0 or more. Without topics there are no rows."""
    return _best(cosines(docs.filter("topic = -1"), [id_col], "embedding", centroids(docs), ["topic"]), id_col, threshold, digits)


def by_ctfidf(counts: DataFrame, scores: DataFrame, threshold: float = 0.0, id_col: str = "doc_id", digits: int = 8, ids: DataFrame | None = None) -> DataFrame:
    """(id, topic, sim) of the documents ids (those of counts if it isn't given), from their counts (id, term, n), by cosine with the topics of scores (topic, term, score).

    The product is a sparse join on terms. A topic that shares no term with a
    document has a cosine of 0, so a document that shares none with any gets the lowest
    topic at a threshold of 0 or less. Without topics there are no rows.
    """
    kind = scores.schema["topic"].dataType
    of_doc = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("dn"))
    of_topic = scores.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("tn"))
    products = counts.join(scores, "term").groupBy(id_col, "topic").agg(F.sum(F.col("n") * F.col("score")).alias("p"))
    sims = products.join(of_doc, id_col).join(of_topic, "topic")
    sims = sims.select(id_col, "topic", (F.col("p") / F.greatest("dn", F.lit(1e-9)) / F.greatest("tn", F.lit(1e-9))).alias("sim"))
    # The best of each document is known before its absent topics are, of which only the lowest can win, so no document meets all topics.
    best = sims.withColumn("sim", F.round("sim", digits) + 0.0).groupBy(id_col).agg(F.min(F.struct((-F.col("sim")).alias("less"), "topic")).alias("b"), F.collect_set("topic").alias("had"))
    topics = scores.agg(F.sort_array(F.collect_set("topic")).alias("ts"))
    known = (counts if ids is None else ids).select(id_col).distinct()
    both = known.join(best, id_col, "left").crossJoin(F.broadcast(topics)).filter(F.size("ts") > 0)
    absent = F.get(F.array_except("ts", F.coalesce("had", F.array().cast(topics.schema["ts"].dataType))), F.lit(0))
    sim, topic = -F.col("b.less"), F.col("b.topic")
    zero = absent.isNotNull() & (topic.isNull() | (sim < 0) | ((sim == 0) & (absent < topic)))
    top = both.select(id_col, F.when(zero, absent).otherwise(topic).alias("topic"), (F.when(zero, F.lit(0.0)).otherwise(sim) + 0.0).alias("sim"))
    return top.select(id_col, F.when(F.col("sim") >= threshold, F.col("topic")).otherwise(F.lit(-1).cast(kind)).alias("topic"), "sim")


def merged(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with the outliers' new topics."""
    new = found.select(id_col, F.col("topic").alias("_t"))
    return docs.join(new, id_col, "left").withColumn("topic", F.coalesce("_t", "topic")).drop("_t")
