"""Queries of the training-data operators: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, lines, minhash, quality, recurrent, toxicity, vectors, warc
from .common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.training_rows(table(spark, sf_dir, "conversations"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_groups(table(spark, sf_dir, "embeddings"))


def wide_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_embeddings at a threshold that random vectors reach as well, so that its SQL has links to check."""
    return vectors.near_groups(table(spark, sf_dir, "embeddings"), WIDE, miss=1e-9)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokens(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.log_likelihoods(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.distinct_pages(table(spark, sf_dir, "pages"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_spans(table(spark, sf_dir, "documents"))


#: Threshold of wide_vector_groups.
WIDE = 0.4

QUERIES = {f.__name__: f for f in (op1_minhash, op2_chat, op3_embeddings, op4_decontamination, op5_bpe, op6_toxicity, op7_quality, op8_language_model, op9_warc, op10_substring, wide_vector_groups)}
ORACLE: dict[str, str] = {"op3_embeddings": vectors.oracle(vectors.THRESHOLD), "wide_vector_groups": vectors.oracle(WIDE), "op9_warc": warc.ORACLE, "op10_substring": lines.ORACLE}
