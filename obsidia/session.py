"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Nanosecond times are BIGINT; calendar functions need UTC.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app: str = "obsidia") -> SparkSession.Builder:
    """Session builder with those settings; the caller sets the master."""
    return SparkSession.builder.appName(app).config(map=CONF)
