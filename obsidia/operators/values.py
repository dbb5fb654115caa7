"""Results of PromQL expressions while a query is compiled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Vector:
    """``df``: ``k, sig, value, ots_ns`` (the time of the sample itself); one row per series and step."""

    df: DataFrame


@dataclass
class Text:
    """A string literal."""

    value: str


@dataclass
class Scalar:
    """A value per step: a column of the step, or, where it depends on data, ``df`` with ``k, scalar``."""

    of: Callable[[Column], Column] | None = None
    df: DataFrame | None = None
    constant: float | None = None

    @staticmethod
    def number(x: float) -> Scalar:
        return Scalar(of=lambda k: F.lit(float(x)), constant=float(x))

    def attach(self, df: DataFrame, name: str = "scalar") -> DataFrame:
        """Adds the value at each row's step."""
        if self.df is None:
            return df.withColumn(name, self.of(F.col("k")))
        return df.join(self.df.withColumnRenamed("scalar", name), "k", "left")
