"""Tokens and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two or more letters, digits or underscores; the same in Java's and DuckDB's regular expressions.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column, ngrams: int = 1) -> Column:
    """The lower-case tokens of a text, followed by its runs of 2 .. ngrams of them; none for null."""
    one = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    out = one
    for n in range(2, ngrams + 1):
        out = F.concat(out, _runs(one, n))
    return out


def _runs(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    runs = F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))
    return F.coalesce(runs, F.array().cast("array<string>"))


def term_counts(docs: DataFrame, keys: list[str], text_col: str = "text", ngrams: int = 1) -> DataFrame:
    """(keys..., term, n) over the documents of the same keys."""
    return docs.select(*keys, F.explode(tokens(F.col(text_col), ngrams)).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def frequent_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """(term, df) of the terms in min_df documents or more, and in no larger share of them than max_df."""
    per_doc = docs.select(id_col, F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    total = docs.agg(F.count("*").alias("_docs"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("_docs"))).drop("_docs")
