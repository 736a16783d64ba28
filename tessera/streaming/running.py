"""The associative workloads on unbounded input, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.climate import means, readings
from ..operators.words import WHITESPACE


def running_means(obs: DataFrame, *, late: str = "30 days", dedupe: bool = True) -> DataFrame:
    """Station means that grow with the stream (complete or update mode).

    Re-delivered readings count once while they come within ``late`` of ``loaded_at``,
    which also bounds the state kept for it.
    """
    rows = obs.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["obs_id"]) if dedupe else obs
    return means(readings(rows, key=None), "station")


def windowed_token_counts(texts: DataFrame, *, text: str = "text", time: str = "loaded_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window, token, occurrences): token counts for each window of event time; a window closes ``late`` after its end."""
    timed = texts.select(F.col(time).cast("timestamp").alias("t"), F.col(text).alias("text")).withWatermark("t", late)
    tokens = timed.select("t", F.explode(F.split("text", WHITESPACE)).alias("token")).filter("token <> ''")
    return tokens.groupBy(F.window("t", window), "token").agg(F.count("*").alias("occurrences"))
