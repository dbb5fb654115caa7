"""Native histograms: exponential (or custom) buckets held as index-to-count maps.

Field access and aggregation are DataFrame expressions; quantiles, fractions and the reduction of a window, which walk
buckets in order, are vectorised Python over Arrow batches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPE = "struct<scale:int,zero_threshold:double,zero_count:double,count:double,sum:double,pos:map<int,double>,neg:map<int,double>,custom:array<double>,hint:string>"
CUSTOM = -53


@dataclass
class HistVector:
    """``df``: ``k, sig, hist, ots_ns``."""

    df: DataFrame


def _dict(m) -> dict[int, float]:
    return dict(m) if m is not None else {}


def bound(h: dict, index: int) -> float:
    """Upper bound of a positive bucket."""
    if h["scale"] == CUSTOM:
        c = h["custom"]
        return -math.inf if index < 0 else c[index] if index < len(c) else math.inf
    return 2.0 ** (index * 2.0 ** -h["scale"])


def buckets(h: dict) -> list[tuple[float, float, float]]:
    """(lower, upper, count) from the lowest value up; a one-sided zero bucket ends at zero."""
    pos, neg = _dict(h["pos"]), _dict(h["neg"])
    out = [(-bound(h, i), -bound(h, i - 1), c) for i, c in sorted(neg.items(), reverse=True)]
    if h["scale"] != CUSTOM and h["zero_count"]:
        z = h["zero_threshold"]
        out.append((0.0 if pos and not neg else -z, 0.0 if neg and not pos else z, h["zero_count"]))
    return out + [(bound(h, i - 1), bound(h, i), c) for i, c in sorted(pos.items())]


def _logarithmic(h: dict, low: float, high: float) -> bool:
    return h["scale"] != CUSTOM and math.isfinite(low) and math.isfinite(high) and low * high > 0


def quantile(q: float, h: dict) -> float:
    """Value at a quantile, interpolated on a logarithmic scale within exponential buckets."""
    if math.isnan(q) or not h["count"]:
        return math.nan
    if q < 0 or q > 1:
        return -math.inf if q < 0 else math.inf
    filled = [b for b in buckets(h) if b[2]]
    if not filled:
        return math.nan
    rank, before = q * h["count"], 0.0
    for low, high, n in filled:
        if before + n >= rank:
            if math.isinf(high):
                return low
            if math.isinf(low):
                return high
            part = (rank - before) / n
            return low * (high / low) ** part if _logarithmic(h, low, high) else low + (high - low) * part
        before += n
    return filled[-1][1]


def fraction(low: float, high: float, h: dict) -> float:
    """Share of observations between two bounds."""
    if math.isnan(low) or math.isnan(high) or not h["count"]:
        return math.nan
    if low >= high:
        return 0.0

    def rank(at: float) -> float:
        if math.isinf(at):
            return h["count"] if at > 0 else 0.0
        total = 0.0
        for a, b, n in buckets(h):
            if at >= b:
                total += n
                continue
            if at > a:
                part = math.log(at / a) / math.log(b / a) if _logarithmic(h, a, b) else (at - a) / (b - a) if b > a else 0.0
                total += n * part
            break
        return total

    return min(1.0, max(0.0, (rank(high) - rank(low)) / h["count"]))


def rescaled(m: dict[int, float], shift: int) -> dict[int, float]:
    """Buckets at a coarser scale."""
    out: dict[int, float] = {}
    for i, c in m.items():
        j = ((i - 1) >> shift) + 1
        out[j] = out.get(j, 0.0) + c
    return out


def _at_scale(h: dict, scale: int) -> dict:
    h = {**h, "pos": _dict(h["pos"]), "neg": _dict(h["neg"])}
    if h["scale"] == CUSTOM or scale >= h["scale"]:
        return h
    shift = h["scale"] - scale
    return {**h, "scale": scale, "pos": rescaled(h["pos"], shift), "neg": rescaled(h["neg"], shift)}


def _plus(a: dict, b: dict, sign: float) -> dict:
    out = dict(a)
    for field in ("zero_count", "count", "sum"):
        out[field] = a[field] + sign * b[field]
    for side in ("pos", "neg"):
        out[side] = {i: a[side].get(i, 0.0) + sign * b[side].get(i, 0.0) for i in sorted(a[side].keys() | b[side].keys())}
    return out


def was_reset(now: dict, before: dict) -> bool:
    """Whether a counter histogram started again."""
    if now["hint"] in ("gauge", "no"):
        return False
    if now["hint"] == "yes" or now["count"] < before["count"] or now["zero_count"] < before["zero_count"] or now["scale"] != before["scale"]:
        return True
    return any(_dict(now[s]).get(i, 0.0) < c for s in ("pos", "neg") for i, c in _dict(before[s]).items())


def reduce_window(ts: list[int], hists: list[dict], end: int, range_ns: int, counter: bool, per_second: bool) -> dict | None:
    """Extrapolated increase of a window as one histogram."""
    if len(ts) < 2:
        return None
    scale = min(h["scale"] for h in hists)
    out = _plus(_at_scale(hists[-1], scale), _at_scale(hists[0], scale), -1.0)
    if counter:
        for before, now in zip(hists, hists[1:]):
            if was_reset(now, before):
                out = _plus(out, _at_scale(before, scale), 1.0)
    seconds = lambda a, b: ((b - a) // 1_000_000) / 1000.0
    span = seconds(ts[0], ts[-1])
    mean = span / (len(ts) - 1)
    reach = span + sum(gap if gap < 1.1 * mean else mean / 2 for gap in (seconds(end - range_ns, ts[0]), seconds(ts[-1], end)))
    factor = reach / span / (range_ns / 1e9 if per_second else 1.0)
    for field in ("zero_count", "count", "sum"):
        out[field] *= factor
    return {**out, "pos": {i: c * factor for i, c in out["pos"].items()}, "neg": {i: c * factor for i, c in out["neg"].items()}, "hint": "gauge"}


def rate(windows: DataFrame, range_ns: int, counter: bool, per_second: bool) -> DataFrame:
    """``k, sig, hist`` of ``rate``, ``increase`` or ``delta``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_ns")
        hists = [h if isinstance(h, dict) else h.asDict(recursive=False) for h in pdf["hist"]]
        out = reduce_window(pdf["ts_ns"].tolist(), hists, int(pdf["t_ns"].iloc[0]), range_ns, counter, per_second)
        rows = [] if out is None else [(pdf["k"].iloc[0], pdf["sig"].iloc[0], out)]
        return pd.DataFrame(rows, columns=["k", "sig", "hist"])

    return windows.select("k", "sig", "t_ns", "ts_ns", "hist").groupBy("k", "sig").applyInPandas(one, f"k long, sig string, hist {TYPE}")


def quantiles(df: DataFrame) -> DataFrame:
    """``k, sig, value`` at the quantile in column ``q``."""
    return _mapped(df.select("k", "sig", "hist", "q"), lambda r: quantile(r["q"], r["hist"]))


def fractions(df: DataFrame) -> DataFrame:
    """``k, sig, value`` between columns ``lower`` and ``upper``."""
    return _mapped(df.select("k", "sig", "hist", "lower", "upper"), lambda r: fraction(r["lower"], r["upper"], r["hist"]))


def _mapped(df: DataFrame, f) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("sig"), pa.array([f(r) for r in batch.to_pylist()], pa.float64())], names=["k", "sig", "value"])

    return df.mapInArrow(run, "k long, sig string, value double")


def added(df: DataFrame, average: bool) -> DataFrame:
    """``k, g, hist``: sum or mean by step and group at the coarsest scale; buckets are summed before they meet."""
    least = df.groupBy("k", "g").agg(F.min("hist.scale").alias("scale"), F.count("*").alias("n"), F.max("hist.zero_threshold").alias("zero_threshold"), F.sum("hist.zero_count").alias("zero_count"), F.sum("hist.count").alias("count"), F.sum("hist.sum").alias("sum"), F.first("hist.custom").alias("custom"))
    shift = F.when(F.col("hist.scale") == CUSTOM, 0).otherwise(F.col("hist.scale") - F.col("scale"))

    def entries(side: str) -> Column:
        return F.transform(F.map_entries(F.coalesce(f"hist.{side}", F.expr("map()").cast("map<int,double>"))), lambda e: F.struct(F.lit(side).alias("side"), e["key"].alias("i"), e["value"].alias("c")))

    each = df.join(least.select("k", "g", "scale"), ["k", "g"]).select("k", "g", shift.alias("shift"), F.explode(F.concat(entries("pos"), entries("neg"))).alias("e"))
    merged = (F.floor((F.col("e.i") - 1) / F.pow(F.lit(2.0), "shift")) + 1).cast("int")
    summed = each.groupBy("k", "g", F.col("e.side").alias("side"), merged.alias("i")).agg(F.sum("e.c").alias("c"))
    sides = summed.groupBy("k", "g").agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("i", "c"))))).alias(s) for s in ("pos", "neg")])
    by = F.col("n") if average else F.lit(1)
    none = F.expr("map()").cast("map<int,double>")
    side = lambda s: F.transform_values(F.coalesce(s, none), lambda k, v: v / by)
    hist = F.struct("scale", "zero_threshold", (F.col("zero_count") / by).alias("zero_count"), (F.col("count") / by).alias("count"), (F.col("sum") / by).alias("sum"), side("pos").alias("pos"), side("neg").alias("neg"), "custom", F.lit("gauge").alias("hint"))
    return least.join(sides, ["k", "g"], "left").select("k", "g", hist.alias("hist"))
