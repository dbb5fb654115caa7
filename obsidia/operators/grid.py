"""Evaluation grids and the assignment of samples to them.

A sample belongs to the steps whose left-open, right-closed window ``(t - range, t]`` holds it. The first and last such
step follow from integer arithmetic on nanoseconds, so windows are an explode and a hash aggregation, never a range join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsidia.errors import InvalidRange, NonPositiveStep, TooManyPoints

MAX_STEPS = 11_000


@dataclass(frozen=True)
class Grid:
    """``n`` times ``start + k * step`` in nanoseconds."""

    start: int
    step: int
    n: int

    @staticmethod
    def instant(at: int) -> Grid:
        return Grid(at, 1, 1)

    @staticmethod
    def range(start: int, end: int, step: int) -> Grid:
        if step <= 0:
            raise NonPositiveStep("step must be positive")
        if end < start:
            raise InvalidRange("end lies before start")
        n = (end - start) // step + 1
        if n > MAX_STEPS:
            raise TooManyPoints(f"{n} steps are more than {MAX_STEPS}")
        return Grid(start, step, n)

    @property
    def end(self) -> int:
        return self.start + (self.n - 1) * self.step

    def time(self, k: Column) -> Column:
        return F.lit(self.start) + k * F.lit(self.step)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.n).select(F.col("id").alias("k"))


def ceil_div(x: Column, by: int) -> Column:
    """Ceiling of a possibly negative quotient of whole numbers."""
    return F.call_function("div", x, F.lit(by)) + F.when(x % F.lit(by) > 0, 1).otherwise(0)


def assign(samples: DataFrame, grid: Grid, range_ns: int, offset_ns: int, at: int | None) -> DataFrame:
    """Samples with the steps ``k`` whose window holds them and that window's end ``t_ns``.

    With a pinned time there is one window, step 0; ``spread`` copies what comes of it to all steps.
    """
    if at is not None or grid.n == 1:
        t = (grid.start if at is None else at) - offset_ns
        inside = (F.col("ts_ns") > t - range_ns) & (F.col("ts_ns") <= t)
        return samples.where(inside).withColumns({"k": F.lit(0).cast("long"), "t_ns": F.lit(t).cast("long")})
    first = grid.start - offset_ns
    last = first + (grid.n - 1) * grid.step
    gap = F.col("ts_ns") - F.lit(first)
    low = F.greatest(ceil_div(gap, grid.step), F.lit(0).cast("long"))
    high = F.least(ceil_div(gap + F.lit(range_ns), grid.step) - 1, F.lit(grid.n - 1).cast("long"))
    inside = samples.where((F.col("ts_ns") > first - range_ns) & (F.col("ts_ns") <= last))
    held = inside.withColumns({"_low": low, "_high": high}).where("_low <= _high")
    return held.withColumn("k", F.explode(F.sequence("_low", "_high"))).withColumn("t_ns", F.lit(first) + F.col("k") * F.lit(grid.step)).drop("_low", "_high")


def spread(df: DataFrame, grid: Grid) -> DataFrame:
    """Copies step 0 to every step, for pinned times."""
    if grid.n == 1:
        return df
    return df.drop("k").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.n - 1).cast("long"))))
