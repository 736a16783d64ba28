"""Sinks: the text formats of the workloads, and single-file output for small results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def tab_text(df: DataFrame, path: str, columns: list[str] | None = None, compression: str = "none") -> None:
    """One line for each row, fields separated by tabs; nulls are empty."""
    df.select(F.concat_ws("\t", *(_text(F.col(c)) for c in columns or df.columns)).alias("value")).write.option("compression", compression).text(path)


def value_text(df: DataFrame, path: str, column: str) -> None:
    """The values of one column as lines, without a key."""
    df.select(_text(F.col(column)).alias("value")).write.text(path)


def tuple_text(df: DataFrame, path: str, columns: list[str]) -> None:
    """Lines ``(a,b)`` in a single file; for small results only, such as a top list."""
    line = F.concat(F.lit("("), F.concat_ws(",", *(_text(F.col(c)) for c in columns)), F.lit(")"))
    df.select(line.alias("value")).coalesce(1).write.text(path)


def single_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A single CSV file with a header, for small results such as predictions of one delivery."""
    df.select(*columns).coalesce(1).write.option("header", "true").csv(path)


def matrix_text(df: DataFrame, path: str) -> None:
    """Lines ``M,row,column,share``."""
    df.select(F.concat_ws(",", F.lit("M"), _text(F.col("i")), _text(F.col("j")), _text(F.col("v"))).alias("value")).write.text(path)


def console(df: DataFrame, rows: int = 20) -> None:
    df.show(rows, truncate=False)
