"""Dense numbers in sort order without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged


def dense_numbers(df: DataFrame, order: list[Column], out: str = "idx") -> DataFrame:
    """``df`` with 0-based row numbers along ``order`` (which should be unique).

    A range shuffle puts the rows in order over many tasks; each numbers its own,
    and a running sum of the tasks' row counts - one row for each task - is added.
    The ranges are written once, so both steps see the same.
    """
    parts = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    local = parts.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = counts.select(F.col("__part").alias("__p"), "__n").withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return local.join(offsets, F.col("__part") == F.col("__p")).withColumn(out, F.col("__row") - 1 + F.col("__offset")).drop("__part", "__p", "__row", "__offset")
