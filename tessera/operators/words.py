"""Counts of whitespace-delimited tokens, and top-k with ties in name order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHITESPACE = "[ \t\n\r\f]+"


def tokens(df: DataFrame, text: str) -> DataFrame:
    """One row for each token; punctuation stays attached, null and empty texts have none."""
    return df.select(F.explode(F.split(F.col(text), WHITESPACE)).alias("token")).filter("token <> ''")


def token_counts(df: DataFrame, text: str) -> DataFrame:
    return tokens(df, text).groupBy("token").agg(F.count("*").alias("occurrences"))


def top_k(df: DataFrame, value: str, tie: str, k: int = 100) -> DataFrame:
    """The ``k`` rows of greatest ``value``; equal values stand in the order of ``tie``, none is lost."""
    return df.orderBy(F.col(value).desc_nulls_last(), F.col(tie).asc_nulls_last()).limit(k)
