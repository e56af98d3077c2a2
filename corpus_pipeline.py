"""Corpus pipeline over documents: toxicity, MinHash near-dedup, substring dedup, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents, which may be any that
include doc_id and text. Null and empty texts, null ids and empty tables pass
through every stage; see the operators for what each does with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicloom.llm import bpe, decontaminate, lines, minhash, toxicity
from topicloom.llm.common import table, written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier finds toxic. It is fitted on the labelled rows among all documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.drop_near_copies(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that an earlier document has."""
    return lines.drop_repeated(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, roundtrip) of each document left."""
    return bpe.tokens(docs)


STAGES = [("toxicity", clean), ("near_dedup", unlike), ("substring_dedup", unrepeated), ("decontamination", untested), ("bpe", encoded)]

#: No SQL: a fitted classifier, MinHash search and merge rules are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each one's result written in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
