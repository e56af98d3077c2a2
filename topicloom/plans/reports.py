"""The tables behind topic charts, and small HTML pages of them."""

from __future__ import annotations

import html
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Categories and the words that put a topic in them, by default.
CATEGORIES = {"work": ["job", "office"], "travel": ["train", "road"], "people": ["family", "friend"]}


def _top(df: DataFrame, n: int, by: str = "n", key: str = "topic") -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(n)


def topic_sizes(docs: DataFrame, keywords: DataFrame, top_n: int = 25, words: int = 4) -> DataFrame:
    """(topic, n, words): the largest topics and their first words (topic, rank, word, score)."""
    sizes = _top(docs.groupBy("topic").agg(F.count("*").alias("n")), top_n)
    first = keywords.filter(F.col("rank") <= words).groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("w"))
    return sizes.join(first, "topic", "left").select("topic", "n", F.array_join(F.coalesce(F.col("w.word"), F.array().cast("array<string>")), " | ").alias("words"))


def sample(points: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """n rows drawn by the hash of their id; the same ones each time."""
    return points.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(n)


def similarity(keywords: DataFrame, words: int = 20) -> DataFrame:
    """(a, b, sim): cosine of every two topics over the scores of their first words."""
    k = keywords.filter(F.col("rank") <= words).select("topic", "word", "score")
    length = k.groupBy("topic").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("l"))
    a, b = k.select(F.col("topic").alias("a"), "word", F.col("score").alias("x")), k.select(F.col("topic").alias("b"), "word", F.col("score").alias("y"))
    common = a.join(b, "word").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
    grid = length.select(F.col("topic").alias("a"), F.col("l").alias("la")).crossJoin(length.select(F.col("topic").alias("b"), F.col("l").alias("lb")))
    sim = F.coalesce(F.col("p"), F.lit(0.0)) / F.greatest(F.col("la") * F.col("lb"), F.lit(1e-12))
    return grid.join(common, ["a", "b"], "left").select("a", "b", sim.alias("sim"))


def network(keywords: DataFrame, words: int = 15, least: float = 0.15) -> DataFrame:
    """(a, b, sim), a < b: the pairs of topics that are alike by more than least."""
    return similarity(keywords, words).filter((F.col("a") < F.col("b")) & (F.col("sim") > least))


def network_layout(keywords: DataFrame, words: int = 15, rounds: int = 100, seed: int = 42) -> DataFrame:
    """(topic, x, y) of a spring layout; topics attract each other by their similarity above 0.1. It is made on the driver, for a chart's topics."""
    import numpy as np

    rows = similarity(keywords, words).collect()
    names = sorted({r.a for r in rows})
    at = {t: i for i, t in enumerate(names)}
    sim = np.zeros((len(names), len(names)))
    for r in rows:
        sim[at[r.a], at[r.b]] = r.sim
    y = np.random.default_rng(seed).standard_normal((len(names), 2))
    for _ in range(rounds):
        d = y[:, None] - y[None, :]
        dist = np.sqrt((d * d).sum(-1)) + 0.01
        push = (d / dist[..., None] ** 3).sum(1) * 0.1
        pull = (d * np.where(sim > 0.1, sim, 0)[..., None]).sum(1) * 0.1
        y += np.clip(push - pull, -0.5, 0.5)
    return keywords.sparkSession.createDataFrame([(t, float(a), float(b)) for t, (a, b) in zip(names, y, strict=True)], f"topic {keywords.schema['topic'].dataType.simpleString()}, x double, y double")


def over_time(docs: DataFrame, period: str = "year", top_n: int = 10) -> DataFrame:
    """(period, topic, n) for each period and each of the top_n topics, with zeros."""
    placed = docs.filter("topic is not null and ts is not null").select(F.date_trunc(period, "ts").alias("period"), "topic")
    counts = placed.groupBy("period", "topic").agg(F.count("*").alias("n"))
    chosen = _top(placed.groupBy("topic").agg(F.count("*").alias("n")), top_n).select("topic")
    return counts.select("period").distinct().crossJoin(F.broadcast(chosen)).join(counts, ["period", "topic"], "left").select("period", "topic", F.coalesce("n", F.lit(0)).alias("n"))


def share_over_time(docs: DataFrame, period: str = "year", top_n: int = 10) -> DataFrame:
    """(period, topic, percent) of all documents of the period."""
    total = docs.filter("topic is not null and ts is not null").groupBy(F.date_trunc(period, "ts").alias("period")).agg(F.count("*").alias("all"))
    return over_time(docs, period, top_n).join(total, "period").select("period", "topic", (F.col("n") * 100 / F.col("all")).alias("percent"))


def heatmap(docs: DataFrame, topics: list, period: str = "year") -> DataFrame:
    """(period, a column for each topic)."""
    p = docs.filter("ts is not null").groupBy(F.date_trunc(period, "ts").alias("period")).pivot("topic", topics).agg(F.count(F.lit(1)))
    return p.select("period", *[F.coalesce(F.col(f"`{t}`"), F.lit(0)).cast("bigint").alias(str(t)) for t in topics])


def categories(sizes: DataFrame, keywords: DataFrame, table: dict[str, list[str]] | None = None, children: int = 6) -> DataFrame:
    """(category, topic, n): topics whose keywords, as one text, contain a word of the category; the largest few of each. A topic may be in several."""
    table = table or CATEGORIES
    text = keywords.groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list("word")), " ").alias("t"))
    pairs = sizes.sparkSession.createDataFrame([(c, list(ws)) for c, ws in table.items()], "category string, ws array<string>")
    hit = text.crossJoin(F.broadcast(pairs)).filter(F.exists("ws", lambda w: F.contains(F.col("t"), w))).select("category", "topic").join(sizes, "topic")
    best = Window.partitionBy("category").orderBy(F.desc("n"), "topic")
    return hit.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= children).select("category", "topic", "n")


def cloud(keywords: DataFrame) -> DataFrame:
    """(topic, word, size, opacity, bold): 14 to 42 points by the share of the topic's best score."""
    share = F.col("score") / F.greatest(F.max("score").over(Window.partitionBy("topic")), F.lit(1e-12))
    return keywords.select("topic", "word", (14 + F.floor(share * 28)).cast("int").alias("size"), F.round(0.4 + 0.6 * share, 6).alias("opacity"), (share > 0.5).alias("bold"))


def intertopic_map(points: DataFrame, top_n: int = 30) -> DataFrame:
    """(topic, x, y, n, bubble) of the largest topics of (topic, x, y)."""
    t = _top(points.filter("topic >= 0").groupBy("topic").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")), top_n)
    return t.withColumn("bubble", 20 + F.col("n") * 60 / F.max("n").over(Window.partitionBy(F.lit(0))))


def representatives(docs: DataFrame, top_n: int = 20, each: int = 5, most: int = 200) -> DataFrame:
    """(topic, rank, doc_id, text): the longest texts of the largest topics, cut to most characters."""
    chosen = _top(docs.groupBy("topic").agg(F.count("*").alias("n")), top_n).select("topic")
    best = Window.partitionBy("topic").orderBy(F.desc(F.length("text")), "doc_id")
    ranked = docs.filter("text is not null").join(F.broadcast(chosen), "topic").withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= each).select("topic", "rank", "doc_id", F.substring("text", 1, most).alias("text"))


def trajectories(centroids: DataFrame, drifting: DataFrame) -> DataFrame:
    """(topic, bin, x, y): paths of the most drifting topics in their two leading components."""
    from ..operators.reduce import components
    from ..functions.vectors import dot

    some = centroids.join(F.broadcast(drifting.select("topic")), "topic")
    mean, top = components(some, 2)

    def axis(k: int):
        return dot(F.zip_with("vec", F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m), F.array(*[F.lit(float(t)) for t in top[:, k]]))

    return some.select("topic", "bin", axis(0).alias("x"), axis(1).alias("y"))


def match_corpora(a: DataFrame, b: DataFrame) -> DataFrame:
    """(topic, match, sim, band): for each topic of a the nearest of b by centroid cosine, with its strength."""
    from ..functions.vectors import cosines

    sims = cosines(a.withColumnRenamed("topic", "ta"), ["ta"], "vec", b, ["topic"]).withColumn("sim", F.round("sim", 6) + 0.0)
    best = Window.partitionBy("ta").orderBy(F.desc("sim"), "topic")
    one = sims.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    band = F.when(F.col("sim") > 0.85, "same").when(F.col("sim") >= 0.7, "related").otherwise("different")
    return one.select(F.col("ta").alias("topic"), F.col("topic").alias("match"), "sim", band.alias("band"))


def page(title: str, df: DataFrame, rows: int = 1000) -> str:
    """A table of a report's rows as HTML; a report is small."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
    return f"<!DOCTYPE html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def write_pages(tables: dict[str, DataFrame], folder: str, prefix: str = "") -> list[str]:
    """One page for each table."""
    os.makedirs(folder, exist_ok=True)
    paths = []
    for name, df in tables.items():
        path = os.path.join(folder, f"{name}.html")
        with open(path, "w", encoding="utf-8") as f:
            f.write(page(f"{prefix}{name.replace('_', ' ')}", df))
        paths.append(path)
    return paths
