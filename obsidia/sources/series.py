"""Where PromQL samples come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidia.functions import labels as L
from obsidia.plans.ast import Matcher


@dataclass
class SeriesSource:
    """Metrics by name; each gives ``labels map, ts_ns, value, stale``. Only metrics that a selector can name are read."""

    metrics: dict[str, Callable[[], DataFrame]]
    histograms: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def native(self, matchers: list[Matcher]) -> DataFrame | None:
        """``sig, ts_ns, hist, stale`` of native histograms, if the selector names any; each has ``labels map`` too."""
        parts = []
        for name in self.named(matchers, self.histograms):
            df = self.histograms[name]()
            for m in matchers:
                if m.name != "__name__":
                    df = df.where(L.matches(F.col("labels"), m.name, m.op, m.value))
            parts.append(df.select(L.sig_of(F.map_concat(F.create_map(F.lit("__name__"), F.lit(name)), "labels")).alias("sig"), "ts_ns", "hist", "stale"))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def named(self, matchers: list[Matcher], among: dict | None = None) -> list[str]:
        import re

        def fits(name: str, m: Matcher) -> bool:
            hit = name == m.value if m.op in ("=", "!=") else re.fullmatch(m.value, name) is not None
            return hit == (m.op in ("=", "=~"))

        return [n for n in (self.metrics if among is None else among) if all(fits(n, m) for m in matchers if m.name == "__name__")]

    def raw(self, matchers: list[Matcher], low: int | None = None, high: int | None = None) -> DataFrame | None:
        """Samples of all matching series, with the metric name among their labels.

        Where a metric also carries the physical ``ts``, the bounds (widened to microseconds) become a filter on it that
        reaches the scan; exact windows are applied later.
        """
        parts = []
        for name in self.named(matchers):
            df = self.metrics[name]()
            if low is not None and "ts" in df.columns:
                df = df.where((F.col("ts") >= _literal(low // 1000)) & (F.col("ts") <= _literal(-(-high // 1000))))
            for m in matchers:
                if m.name != "__name__":
                    df = df.where(L.matches(F.col("labels"), m.name, m.op, m.value))
            parts.append(df.select(F.map_concat(F.create_map(F.lit("__name__"), F.lit(name)), "labels").alias("labels"), "ts_ns", "value", "stale"))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def samples(self, matchers: list[Matcher], low: int | None = None, high: int | None = None) -> DataFrame:
        """``sig, ts_ns, value, stale``; samples outside of ``[low, high]`` may be left out."""
        found = self.raw(matchers, low, high)
        if found is None:
            found = next(iter(self.metrics.values()))().where(F.lit(False))
        return found.select(L.sig_of(F.col("labels")).alias("sig"), "ts_ns", "value", "stale")


def _literal(micros: int) -> Column:
    when = datetime(1970, 1, 1) + timedelta(microseconds=min(max(micros, -62_000_000_000_000_000), 250_000_000_000_000_000))
    return F.expr(f"timestamp_ntz'{when.isoformat(sep=' ')}'")


def deduplicated(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """One value per key, of the row that is greatest by provenance and then value; one hash aggregation."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("x"))
    return best.select(*keys, F.col(f"x.{value}").alias(value))
