"""Topic counts over event time from a stream of (topic, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, topic, n) of each window; rows later than late are left out once their window is done. It works on tables too."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window.alias("w"), "topic").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "topic", "n")
