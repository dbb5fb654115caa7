"""Structured Streaming forms of the time- and state-bearing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(df: DataFrame, keys: list[str], ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """First row of each key within the lateness bound; replays inside it are dropped."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def hopping(df: DataFrame, keys: list[str], length: str, every: str, ts: str = "ts", value: str = "value", late: str = "2 hours") -> DataFrame:
    """Left-open, right-closed windows as range queries have them: times move back a microsecond before windowing.

    Gives ``keys, end, n, total, low, high``; append mode emits a window once the watermark passes it.
    """
    moved = df.withWatermark(ts, late).withColumn("_w", F.window(F.col(ts) - F.expr("INTERVAL 1 MICROSECOND"), length, every))
    out = moved.groupBy("_w", *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(*keys, F.col("_w.end").alias("end"), "n", "total", "low", "high")
