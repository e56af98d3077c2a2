"""Readers and writers: tables, keyword files, embedding files, models, and the shared folder for cut lineages."""

from __future__ import annotations

import io
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; timestamps without a zone are read as UTC."""
    df = spread(spark.read.parquet(f"{folder}/{name}.parquet"))
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where the files have fewer splits than that, as a single small file has; large inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in plain local mode a temporary one if that is unset."""
    global _local
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local is None:
        import atexit

        _local = tempfile.mkdtemp(prefix="topicloom-tables-")
        atexit.register(shutil.rmtree, _local, True)
    return f"file://{_local}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder, where the lineage ends; it goes with the application."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(topic, rank, word, score) from JSON of the form {topic: [[word, score], ...]}."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<array<string>>>").alias("m"))
    return raw.select(F.explode("m").alias("topic", "pairs")).select(F.col("topic").cast("int").alias("topic"), F.posexplode("pairs").alias("rank", "p")).select("topic", (F.col("rank") + 1).alias("rank"), F.col("p")[0].alias("word"), F.col("p")[1].cast("double").alias("score"))


def keywords_json(keywords: DataFrame) -> str:
    """The reverse of read_keywords, for a report's few topics."""
    rows = keywords.orderBy("topic", "rank").select("topic", "word", "score").collect()
    out: dict[str, list] = {}
    for topic, word, score in rows:
        out.setdefault(str(topic), []).append([word, score])
    return json.dumps(out, ensure_ascii=False)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(row, vec) of 2-D .npy files; rows count from 0 in each file."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                x = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                for at in range(0, len(x), 10_000):
                    part = x[at : at + 10_000].astype(np.float32)
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * x.shape[1]), pa.array(part.ravel()))
                    yield pa.record_batch([pa.array(np.arange(at, at + len(part))), vec], ["row", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "row long, vec array<float>")


def save_model(path: str, parts: dict[str, DataFrame], about: dict) -> None:
    """A model as a folder of tables and its parameters."""
    spark = next(iter(parts.values())).sparkSession
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], dict]:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}, about
