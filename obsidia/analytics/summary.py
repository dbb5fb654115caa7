"""Robust summary of each series: two hash aggregations, no Python."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.errors import InvalidPercentile


def summary(df: DataFrame, keys: list[str], value: str = "value", percentiles: tuple[float, ...] = (50, 95, 99)) -> DataFrame:
    """``n, nan_excluded, median, mad, variance, stddev`` and ``p<q>`` per key; NaN counts as excluded."""
    for p in percentiles:
        if not 0 <= p <= 100:
            raise InvalidPercentile(str(p))
    v = F.when(~F.isnan(value), F.col(value))
    stats = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.sum(F.isnan(value).cast("long")).alias("nan_excluded"), F.percentile(v, F.lit(0.5)).alias("median"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("stddev"),
        *[F.percentile(v, F.lit(p / 100)).alias(f"p{p:g}") for p in percentiles],
    )
    spread = df.join(stats.select(*keys, "median"), keys).groupBy(*keys).agg(F.percentile(F.abs(v - F.col("median")), F.lit(0.5)).alias("mad"))
    return stats.join(spread, keys)
