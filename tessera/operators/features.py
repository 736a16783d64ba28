"""Preparation of a wide observation table for a classifier."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import dense_numbers

# Columns dropped by name and by prefix, and the categorical ones.
DROPPED = ["COUNTRY", "YEAR", "SAMPLING_EVENT_ID0", "SAMPLING_EVENT_ID953", "LOC_ID954", "SAMPLING_EVENT_ID1016", "LOC_ID1017"]
DROPPED_PREFIXES = ("NLCD", "CAUS")
CATEGORICAL = ["STATE_PROVINCE", "COUNTY", "COUNT_TYPE", "OBSERVER_ID", "GROUP_ID", "BAILEY_ECOREGION", "OMERNIK_L3_ECOREGION", "SUBNATIONAL2_CODE", "LOC_ID1"]
REPLACED = {"?": "-1.0", "X": "1.0", "null": "-1.0"}


def pruned(df: DataFrame, names: list[str] = DROPPED, prefixes: tuple[str, ...] = DROPPED_PREFIXES, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the named and prefixed columns (any case), but for those in ``keep``."""
    gone, kept = {n.upper() for n in names}, {k.upper() for k in keep}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.upper() in kept or not (c.upper() in gone or c.upper().startswith(prefixes))))


def replaced(df: DataFrame, values: dict[str, str] = REPLACED) -> DataFrame:
    """String columns with whole values replaced; other columns untouched."""
    strings = [name for name, kind in df.dtypes if kind == "string"]
    return df.na.replace(values, subset=strings) if strings else df


def prepared(df: DataFrame, *, label: str = "Agelaius_phoeniceus", threshold: float = 1.0, sighting_counts: bool = False, keep_unlabelled: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The feature table: label 1.0 above ``threshold`` sightings, else 0.0, and missing-value rules applied.

    Rows whose label is no number are dropped (``X``, seen but not counted, counts
    as 1 with ``sighting_counts``) unless ``keep_unlabelled``, where they are 0.0.
    """
    text = F.col(label)
    count = F.when(text == "X", F.lit(1.0)).otherwise(text.try_cast("double")) if sighting_counts else text.try_cast("double")
    rows = pruned(df, keep=keep).withColumn("label", count).drop(label)
    if not keep_unlabelled:
        rows = rows.na.drop(subset=["label"])
    rows = rows.withColumn("GROUP_ID", F.when((F.col("GROUP_ID") == "?") | F.col("GROUP_ID").isNull(), "G0000").otherwise(F.col("GROUP_ID")))
    rows = replaced(rows).withColumn("EFFORT_DISTANCE_KM", F.abs(F.col("EFFORT_DISTANCE_KM").try_cast("double"))).withColumn("PRIMARY_CHECKLIST_FLAG", F.col("PRIMARY_CHECKLIST_FLAG").try_cast("double"))
    return rows.withColumn("label", F.when(F.col("label") > threshold, 1.0).otherwise(0.0)).withColumn("COUNT_TYPE_P34", F.when(F.col("COUNT_TYPE") == "P34", 1.0).otherwise(0.0))


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("p")).select("p.column", "p.value")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): distinct values of each column, null counting as one; a single pass over all columns."""
    return _values(df, columns).distinct().groupBy("column").agg(F.count("*").alias("n"))


def largest_cardinality(df: DataFrame, columns: list[str]) -> int:
    return distinct_counts(df, columns).agg(F.max("n")).first()[0] or 0


def frequency_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, rows, idx): non-null values numbered from 0 for each column, the most frequent first, ties in value order."""
    counts = _values(df, columns).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("rows"))
    numbered = dense_numbers(counts, [F.col("column").asc(), F.col("rows").desc(), F.col("value").asc()], "at")
    first = numbered.groupBy(F.col("column").alias("c")).agg(F.min("at").alias("first"))
    return numbered.join(F.broadcast(first), F.col("column") == F.col("c")).select("column", "value", "rows", (F.col("at") - F.col("first")).alias("idx"))  # a row for each column


def numeric(df: DataFrame, except_for: tuple[str, ...] = ()) -> DataFrame:
    """Every column as a double where it is one, else null; ``except_for`` stays as it is."""
    kept = {c.upper() for c in except_for}
    cast = lambda c: F.col(f"`{c}`") if c.upper() in kept else F.col(f"`{c}`").try_cast("double").alias(c)
    return df.select(*(cast(c) for c in df.columns))


def any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNull() for c in columns), F.lit(False))


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    known = df.filter(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return known.unionByName(df.filter(F.col(key).isNull()))
