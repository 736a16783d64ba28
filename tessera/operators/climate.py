"""Conditional means over station readings, and their year-ordered series.

One declarative aggregate covers the three hand-written variants (plain, combiner,
in-mapper table): Spark adds the partial aggregation, so a busy station sends one
buffer for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINEL = -9999.0
LOW, HIGH = "TMIN", "TMAX"


def readings(obs: DataFrame, *, station: str = "station", date: str = "obs_date", element: str = "elem", value: str = "reading", key: str | None = "obs_id", sentinel: float = SENTINEL) -> DataFrame:
    """(station, year, element, value) of the TMIN and TMAX readings.

    Sentinel readings become null and rows with the same ``key`` count once (with
    a null key each counts). The year is the first four characters of the date.
    """
    rows = obs.filter(F.col(element).isin(LOW, HIGH))
    columns = [F.col(station).alias("station"), F.substring(F.col(date), 1, 4).try_cast("int").alias("year"), F.col(element).alias("element"), F.when(F.col(value) != sentinel, F.col(value)).alias("value")]
    if key is None:
        return rows.select(*columns)
    rows = rows.select(F.col(key).alias("key"), *columns)
    return rows.filter("key is not null").dropDuplicates(["key"]).unionByName(rows.filter("key is null")).drop("key")


def _mean(element: str) -> Column:
    return F.avg(F.when(F.col("element") == element, F.col("value")))


def means(rows: DataFrame, *by: str, as_nan: bool = False) -> DataFrame:
    """Mean TMIN and TMAX for each group of ``by``; without readings null, or NaN as the text format has it."""
    pair = {"avg_tmin": _mean(LOW), "avg_tmax": _mean(HIGH)}
    return rows.groupBy(*by).agg(*((F.coalesce(m, F.lit(float("nan"))) if as_nan else m).alias(name) for name, m in pair.items()))


def yearly_series(rows: DataFrame) -> DataFrame:
    """(station, series): the years of each station in order, as an array of (year, avg_tmin, avg_tmax).

    Means are formed per (station, year) first, so a station gathers a row for each
    year, however many readings it has.
    """
    yearly = means(rows.filter("year is not null"), "station", "year")
    return yearly.groupBy("station").agg(F.array_sort(F.collect_list(F.struct("year", "avg_tmin", "avg_tmax"))).alias("series"))


def station_order(rows: DataFrame) -> DataFrame:
    """Yearly means partitioned by station and ordered by year within it (secondary sort), for streaming consumers."""
    return means(rows, "station", "year").repartition("station").sortWithinPartitions("station", "year")


def series_text(series: DataFrame, digits: int = 10) -> DataFrame:
    """The series as text lines: ``, [(1884, 1.0, NaN), (1885, ...)]``."""
    shown = lambda x: F.when(x.isNull() | F.isnan(x), "NaN").otherwise(F.format_string(f"%.{digits}f", x))
    item = lambda s: F.concat(F.lit("("), s["year"].cast("string"), F.lit(", "), shown(s["avg_tmin"]), F.lit(", "), shown(s["avg_tmax"]), F.lit(")"))
    return series.select("station", F.concat(F.lit(", ["), F.array_join(F.transform("series", item), ", "), F.lit("]")).alias("line"))
