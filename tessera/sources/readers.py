"""Scans. Paths may name any file system Spark knows (``file:``, ``hdfs:``, ``s3a:``); compression goes by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLIMATE = T.StructType([T.StructField("station", T.StringType()), T.StructField("obs_date", T.StringType()), T.StructField("elem", T.StringType()), T.StructField("reading", T.DoubleType())])


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row for each line of a file or directory; bz2 files are split among tasks, gz files are not."""
    return spark.read.text(path)


def climate_csv(spark: SparkSession, path: str) -> DataFrame:
    """Station readings without a header; fields beyond the fourth are ignored, short or non-numeric ones become null."""
    return spark.read.schema(CLIMATE).option("mode", "PERMISSIVE").option("enforceSchema", "true").csv(path)


def header_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table with a header line; malformed records are dropped. Without a schema its types are inferred, which costs a pass."""
    reader = spark.read.option("header", "true").option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")).csv(path)


def adjacency_text(spark: SparkSession, path: str) -> DataFrame:
    """(page, links): lines ``page TAB e1|e2``; without a second field the page has no links."""
    fields = F.split("value", "\t", 2)
    links = F.filter(F.split(F.coalesce(F.get(fields, F.lit(1)), F.lit("")), r"\|"), lambda x: x != "")
    return text_lines(spark, path).select(F.get(fields, F.lit(0)).alias("page"), links.alias("links"))


def index_text(spark: SparkSession, path: str) -> DataFrame:
    """(node, idx): lines ``name TAB number``."""
    return spark.read.schema("node string, idx long").option("sep", "\t").csv(path)


def matrix_text(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v): lines ``M,row,column,share``; other record kinds of the same files are skipped."""
    return spark.read.schema("kind string, i long, j long, v double").csv(path).filter("kind = 'M'").drop("kind")


def vector_text(spark: SparkSession, path: str) -> DataFrame:
    """(node, rank): lines ``R,row,0,value`` or ``row,value``."""
    f = F.split("value", ",")
    tagged = f[0] == "R"
    return text_lines(spark, path).select(F.when(tagged, F.get(f, F.lit(1))).otherwise(f[0]).try_cast("long").alias("node"), F.when(tagged, F.get(f, F.lit(3))).otherwise(F.get(f, F.lit(1))).try_cast("double").alias("rank"))


def rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    """A small collection of the driver as a table."""
    return spark.createDataFrame(values, schema)
