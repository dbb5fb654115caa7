"""Maintenance: compaction, retention and selective erasure as batch rewrites."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Erasure:
    """Erase rows whose labels equal all of ``equals``, within ``[start_ns, end_ns)``; zero leaves a side open."""

    equals: dict[str, str] = field(default_factory=dict)
    start_ns: int = 0
    end_ns: int = 0


def erased(requests: list[Erasure], labels: Column, ts_ns: Column) -> Column:
    """Condition of rows that any request covers."""
    out = F.lit(False)
    for r in requests:
        hit = F.lit(True)
        for k, v in r.equals.items():
            hit = hit & (F.coalesce(labels[k], F.lit("")) == v)
        if r.start_ns:
            hit = hit & (ts_ns >= r.start_ns)
        if r.end_ns:
            hit = hit & (ts_ns < r.end_ns)
        out = out | hit
    return out


def erase(df: DataFrame, requests: list[Erasure], labels: str = "labels", ts: str = "ts_ns") -> DataFrame:
    """What is left."""
    return df.where(~erased(requests, F.col(labels), F.col(ts)))


def hour_of(ts: str = "ts_ns") -> Column:
    """Hour bucket of a time."""
    return F.call_function("div", F.col(ts), F.lit(3600 * 10**9))


def expired_hours(df: DataFrame, now_ns: int, keep_ns: int, ts: str = "ts_ns", held: list[int] = ()) -> DataFrame:
    """Hour buckets whose newest row is older than the retention, those under legal hold excepted."""
    hours = df.groupBy(hour_of(ts).alias("hour")).agg(F.max(ts).alias("newest"), F.count("*").alias("rows"))
    return hours.where((F.col("newest") < now_ns - keep_ns) & ~F.col("hour").isin(list(held)))


def retain(df: DataFrame, now_ns: int, keep_ns: int, ts: str = "ts_ns", held: list[int] = ()) -> DataFrame:
    """Rows of hours that have not expired."""
    gone = expired_hours(df, now_ns, keep_ns, ts, held).select("hour")
    return df.withColumn("hour", hour_of(ts)).join(gone, "hour", "left_anti").drop("hour")


def compact(df: DataFrame, target: str, sort: list[str], least_files: int = 2, files: int = 1) -> int:
    """Rewrite into few sorted files unless there are fewer than ``least_files``; rows are never merged, and their number is checked.

    Returns the number of rows.
    """
    before = df.count()
    if len(df.inputFiles()) >= least_files or not df.inputFiles():
        df.repartitionByRange(files, *sort).sortWithinPartitions(*sort).write.mode("overwrite").parquet(target)
        after = df.sparkSession.read.parquet(target).count()
        if after != before:
            raise RuntimeError(f"compaction changed {before} rows to {after}")
    return before
