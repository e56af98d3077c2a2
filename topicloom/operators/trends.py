"""Topics over time: sliding windows of documents, bins of time, centroid drift, change-points and forecasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosines, mean_vectors
from ..sources.tables import settled
from .recurrence import forecast, smooth


def top_topics(docs: DataFrame, n: int) -> DataFrame:
    """(topic, n) of the n most frequent real topics; ties to the lower one."""
    return docs.filter("topic >= 0").groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(n)


def numbered(docs: DataFrame, order: list[str]) -> DataFrame:
    """docs with rn, the place from 0 in this order, without putting all rows in one partition.

    The rows are range-partitioned and sorted once and written; a partition's rows are counted on from the partitions before it.
    """
    placed = settled(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ordered")
    within = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    # One row a partition, so this window is small whatever the rows are.
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return within.join(before, "_p").withColumn("rn", F.col("_before") + F.col("_k") - 1).drop("_p", "_k", "_before")


def raw_trends(docs: DataFrame, window: int = 100, stride: int = 50, topics: int = 50, topic_ids: list[int] | None = None) -> DataFrame:
    """(step, ts, topic, proportion) over windows of so many documents of (id, topic, ts), in the order of (ts, id).

    Windows start at 0, stride, ... below rows - window, so the last whole one is
    left out. Shares are of the tracked topics; a window without any has zeros.
    ts is that of the window's middle row. Fewer than window + 1 rows give no windows.
    """
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(t,) for t in topic_ids], "topic int") if topic_ids is not None else top_topics(docs, topics).select("topic")
    total = docs.agg(F.count("*").alias("_rows"))
    rows = settled(numbered(docs.select("id", "topic", "ts"), ["ts", "id"]), "numbered").crossJoin(F.broadcast(total)).filter(F.col("_rows") > window)
    first = F.greatest(F.lit(0), F.ceil((F.col("rn") - window + 1) / stride)).cast("long")
    last = F.least(F.floor(F.col("rn") / stride), F.ceil((F.col("_rows") - window) / stride) - 1).cast("long")
    member = rows.filter(first <= last).withColumn("step", F.explode(F.sequence(first, last)))
    middle = member.filter(F.col("rn") == F.col("step") * stride + window // 2).select("step", "ts")
    n = member.join(F.broadcast(chosen), "topic").groupBy("step", "topic").agg(F.count("*").alias("n"))
    grid = middle.crossJoin(F.broadcast(chosen)).join(n, ["step", "topic"], "left")
    tracked = F.sum("n").over(Window.partitionBy("step"))
    share = F.when(tracked > 0, F.coalesce(F.col("n"), F.lit(0)) / tracked).otherwise(F.lit(0.0))
    return grid.select(F.col("step").cast("int").alias("step"), "ts", "topic", share.alias("proportion"))


def wide(trends: DataFrame, topics: list[int]) -> DataFrame:
    """(step, ts, topic_<id>...)."""
    p = trends.groupBy("step", "ts").pivot("topic", topics).agg(F.first("proportion"))
    return p.select("step", "ts", *[F.col(f"`{t}`").alias(f"topic_{t}") for t in topics])


def long(trends: DataFrame, top_n: int = 10) -> DataFrame:
    """(step, ts, topic, percent) of the first top_n topic columns, in percent of what is shown."""
    columns = [c for c in trends.columns if c.startswith("topic_")][:top_n]
    melted = trends.unpivot(["step", "ts"], columns, "topic", "proportion")
    shown = F.sum("proportion").over(Window.partitionBy("step"))
    return melted.select("step", "ts", "topic", F.when(shown > 0, F.col("proportion") * 100 / shown).otherwise(F.lit(0.0)).alias("percent"))


def change_points(trends: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(step, change): windows after which the shares change by more than mean + threshold * standard deviation (of the population)."""
    by = Window.partitionBy("topic").orderBy("step")
    moved = trends.withColumn("d", F.abs(F.lead("proportion").over(by) - F.col("proportion"))).filter("d is not null")
    steps = moved.groupBy("step").agg(F.sum("d").alias("change"))
    limit = steps.agg((F.avg("change") + threshold * F.stddev_pop("change")).alias("_limit"))
    return steps.crossJoin(F.broadcast(limit)).filter(F.col("change") > F.col("_limit")).drop("_limit")


def time_bins(docs: DataFrame, bins: int = 20) -> DataFrame:
    """docs with bin: equal widths over the range of ts in whole seconds; one bin if all are equal."""
    s = docs.withColumn("_s", F.unix_seconds("ts"))
    edge = s.agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1), F.floor((F.col("_s") - F.col("_lo")) / width))).otherwise(F.lit(0))
    return s.crossJoin(F.broadcast(edge)).withColumn("bin", at.cast("int")).drop("_s", "_lo", "_hi")


def bin_labels(docs: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, ts): the middle of each bin."""
    edge = docs.agg(F.min(F.unix_seconds("ts")).alias("lo"), F.max(F.unix_seconds("ts")).alias("hi")).filter("lo is not null")
    b = edge.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return b.select("bin", F.timestamp_seconds(F.floor(F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)).alias("ts"))


def bin_centroids(docs: DataFrame, bins: int = 20, min_docs: int = 10, topics: int = 50) -> DataFrame:
    """(topic, bin, vec, n) of the bins with min_docs documents or more, of the most frequent topics."""
    placed = time_bins(docs, bins).join(F.broadcast(top_topics(docs, topics).select("topic")), "topic")
    return mean_vectors(placed, ["topic", "bin"], "embedding").filter(F.col("n") >= min_docs)


def interpolated(found: DataFrame, wanted: DataFrame, bins: int = 20, dims: int | None = None) -> DataFrame:
    """(topic, bin, vec) for every bin of the wanted topics.

    A topic with two bins or more has the others between their neighbours, or as
    its first or last one; any other topic has zeros where it has no centroid.
    """
    if dims is None:
        dims = found.agg(F.max(F.size("vec"))).first()[0] or 0
    grid = wanted.select("topic").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    w = Window.partitionBy("topic").orderBy("bin")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("vec").isNotNull(), F.struct("bin", "vec"))
    g = grid.join(found.select("topic", "bin", "vec"), ["topic", "bin"], "left")
    g = g.select("topic", "bin", "vec", F.last(at, True).over(before).alias("l"), F.first(at, True).over(after).alias("r"), F.count("vec").over(Window.partitionBy("topic")).alias("k"))
    share = (F.col("bin") - F.col("l.bin")) / (F.col("r.bin") - F.col("l.bin"))
    between = F.zip_with("l.vec", "r.vec", lambda x, y: (1 - share) * x + share * y)
    zero = F.array_repeat(F.lit(0.0), dims)
    vec = F.when(F.col("vec").isNotNull(), F.col("vec")).when(F.col("k") < 2, zero).when(F.col("l").isNull(), F.col("r.vec")).when(F.col("r").isNull(), F.col("l.vec")).otherwise(between)
    return g.select("topic", "bin", vec.alias("vec"))


def drift(centroids: DataFrame, labels: DataFrame) -> DataFrame:
    """(topic, bin, ts, drift): 1 minus the cosine with the next bin; ts is that of the earlier one."""

    def length(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) + 1e-8)

    nxt = F.lead("vec").over(Window.partitionBy("topic").orderBy("bin"))
    both = centroids.withColumn("next", nxt).filter("next is not null")
    product = F.aggregate(F.zip_with("vec", "next", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.select("topic", "bin", (1 - product / length(F.col("vec")) / length(F.col("next"))).alias("drift")).join(F.broadcast(labels), "bin").select("topic", "bin", "ts", "drift")


def top_drifting(drifts: DataFrame, n: int = 10, digits: int = 6) -> DataFrame:
    """(topic, total_drift) of the n that drift most; ties to the lower topic."""
    return drifts.groupBy("topic").agg(F.round(F.sum("drift"), digits).alias("total_drift")).orderBy(F.desc("total_drift"), "topic").limit(n)


def drift_change_points(drifts: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(topic, bin, drift): drifts above their topic's mean + threshold * standard deviation (of the population)."""
    by = Window.partitionBy("topic")
    limit = F.avg("drift").over(by) + threshold * F.stddev_pop("drift").over(by)
    return drifts.withColumn("_limit", limit).filter(F.col("drift") > F.col("_limit")).select("topic", "bin", "drift")


def keywords_over_time(centroids: DataFrame, words: DataFrame, top_k: int = 10, digits: int = 6) -> DataFrame:
    """(topic, bin, rank, word, score) by the words' cosine with each bin's centroid."""
    sims = cosines(words, ["word"], "vec", centroids, ["topic", "bin"]).withColumn("score", F.round("sim", digits) + 0.0)
    best = Window.partitionBy("topic", "bin").orderBy(F.desc("score"), "word")
    return sims.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k).select("topic", "bin", "rank", "word", "score")


def _whole(trends: DataFrame, kernel, out: str) -> DataFrame:
    """A kernel over the whole sequence in order: (steps, topics). It is one task; windows are few beside their documents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.pivot(index="step", columns="topic", values="proportion").sort_index()
        return kernel(p.to_numpy(), p.index.to_numpy(), p.columns.to_numpy())

    return trends.groupBy(F.lit(0).alias("_one")).applyInPandas(run, out)


def smoothed(trends: DataFrame, hidden: int = 32, epochs: int = 50, rate: float = 1e-2, seed: int = 0) -> DataFrame:
    """(step, topic, proportion) as a recurrent net predicts it; the row of a step is the prediction of the next one from those up to it."""

    def kernel(x, steps, topics):
        y = smooth(x, hidden, epochs, rate, seed)
        return pd.DataFrame({"step": np.repeat(steps, len(topics)), "topic": np.tile(topics, len(steps)), "proportion": y.ravel()})

    return _whole(trends, kernel, "step int, topic int, proportion double")


def predicted(trends: DataFrame, steps: int = 5, hidden: int = 32, epochs: int = 50, rate: float = 1e-2, seed: int = 0) -> DataFrame:
    """(ahead, topic, proportion): the next steps, each made from the ones before it."""

    def kernel(x, _, topics):
        y = forecast(x, steps, hidden, epochs, rate, seed)
        return pd.DataFrame({"ahead": np.repeat(np.arange(1, steps + 1), len(topics)), "topic": np.tile(topics, steps), "proportion": y.ravel()})

    return _whole(trends, kernel, "ahead int, topic int, proportion double")


def smoothed_centroids(centroids: DataFrame, hidden: int = 32, epochs: int = 30, components: int = 64) -> DataFrame:
    """(topic, bin, vec): each topic's path through the leading components, smoothed by a recurrent net with a linear head. One task: there are topics x bins rows."""
    from .recurrence import smooth_paths

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["topic", "bin"])
        x = np.stack(pdf["vec"].to_numpy())
        y = smooth_paths(x.reshape(pdf["topic"].nunique(), -1, x.shape[1]), min(components, min(x.shape)), hidden, epochs)
        return pd.DataFrame({"topic": pdf["topic"], "bin": pdf["bin"], "vec": list(y.reshape(x.shape))})

    return centroids.groupBy(F.lit(0).alias("_one")).applyInPandas(run, centroids.select("topic", "bin", "vec").schema)


def summary(drifts: DataFrame, labels: DataFrame) -> str:
    """Topics, bins, range of months and the five that drift most."""
    lo, hi, bins = labels.agg(F.date_format(F.min("ts"), "yyyy-MM"), F.date_format(F.max("ts"), "yyyy-MM"), F.count("*")).first()
    topics = drifts.select("topic").distinct().count()
    lines: Iterator[str] = (f"  topic {r.topic}: {r.total_drift:.4f}" for r in top_drifting(drifts, 5).collect())
    return "\n".join([f"{topics} topics, {bins} bins, {lo} to {hi}", *lines])
