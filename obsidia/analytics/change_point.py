"""Change points of single series: PELT segmentation on a Gaussian cost, then one verdict by fixed precedence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from obsidia.errors import SeriesTooLong

LIMIT, FEWEST, SEGMENT = 2000, 22, 15
SCHEMA = "kind string, position long, ts_ns long, p double"


def downsample(ts: np.ndarray, v: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Bucket averages, each at its first time."""
    if len(v) <= limit:
        return ts, v
    edges = np.arange(limit + 1) * len(v) // limit
    return ts[edges[:-1]], np.add.reduceat(v, edges[:-1]) / np.diff(edges)


def pelt(v: np.ndarray, least: int = SEGMENT) -> list[int]:
    """Starts of segments after the first."""
    n = len(v)
    floor = max(1e-12, 0.1 * float(np.var(v)))
    s1, s2 = np.concatenate([[0], np.cumsum(v)]), np.concatenate([[0], np.cumsum(v * v)])
    penalty = 2 * np.log(n)
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = -penalty
    alive = np.array([0])
    for end in range(least, n + 1):
        usable = alive[end - alive >= least]
        m = end - usable
        var = np.maximum((s2[end] - s2[usable]) / m - ((s1[end] - s1[usable]) / m) ** 2, floor)
        cost = best[usable] + m * np.log(var)
        at = int(np.argmin(cost))
        best[end], back[end] = cost[at] + penalty, usable[at]
        kept = usable[cost <= best[end]]
        alive = np.concatenate([kept, alive[end - alive < least], [end - least + 1] if end - least + 1 > 0 else []]).astype(int)
        alive = np.unique(alive)
    out, end = [], n
    while end > 0:
        end = back[end]
        if end > 0:
            out.append(int(end))
    return out[::-1]


def detect(ts: np.ndarray, v: np.ndarray, downsampled: bool = True) -> tuple[str, int, float]:
    """Kind of change, its index (-1 without one) and a score."""
    keep = ~np.isnan(v)
    ts, v = ts[keep], v[keep]
    if len(v) > LIMIT:
        if not downsampled:
            raise SeriesTooLong(f"{len(v)} points are more than {LIMIT}")
        ts, v = downsample(ts, v)
    n = len(v)
    if n < FEWEST:
        return "indeterminable", -1, 0.0
    centre = np.median(v)
    scale = 1.4826 * np.median(np.abs(v - centre)) or float(np.std(v))
    if scale == 0:
        return "stationary", -1, 0.0
    z = (v - centre) / scale
    far = np.flatnonzero(np.abs(z) > 6)
    if 0 < len(far) <= max(1, n // 50):
        at = int(far[np.argmax(np.abs(z[far]))])
        return ("spike" if z[at] > 0 else "dip"), at, float(abs(z[at]))
    cuts = pelt(v)
    x = np.arange(n, dtype=float)
    sse = lambda a, b: float(np.sum((v[a:b] - np.polyval(np.polyfit(x[a:b], v[a:b], 1), x[a:b])) ** 2))
    total = float(np.sum((v - v.mean()) ** 2))
    if cuts:
        options = [(sse(0, c) + sse(c, n), c) for c in range(SEGMENT, n - SEGMENT + 1, max(1, n // 200))]
        two, at = min(options)
        flat = min((float(np.sum((v[:c] - v[:c].mean()) ** 2) + np.sum((v[c:] - v[c:].mean()) ** 2)), c) for c in range(SEGMENT, n - SEGMENT + 1))
        slopes = [np.polyfit(x[a:b], v[a:b], 1)[0] * n for a, b in ((0, at), (at, n))]
        if two < 0.5 * flat[0] and abs(slopes[0] - slopes[1]) > 4 * scale:
            return "trend_change", at, 1 - two / total
        c = max(cuts, key=lambda c: abs(v[:c].mean() - v[c:].mean()) / (np.std(v) or 1))
        spread = np.std(v[:c]), np.std(v[c:])
        shift = abs(v[:c].mean() - v[c:].mean())
        if shift < max(spread) and max(spread) > 2 * max(min(spread), 1e-12):
            return "distribution_change", c, float(max(spread) / max(min(spread), 1e-12))
        if shift > 0.5 * np.std(v):
            return "step_change", flat[1], float(shift / (np.std(v) or 1))
    return "stationary", -1, 0.0


def change_points(df: DataFrame, key: str, ts: str = "ts_ns", value: str = "value") -> DataFrame:
    """``key, kind, position, ts_ns, p`` per series; longer series are averaged into buckets."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)
        times, v = pdf[ts].to_numpy(), pdf[value].to_numpy(dtype=float)
        kind, at, p = detect(times, v)
        keep = ~np.isnan(v)
        when, _ = downsample(times[keep], v[keep])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "kind": [kind], "position": [at], "ts_ns": [int(when[at]) if at >= 0 else None], "p": [p]}).astype({"ts_ns": "Int64"})

    return df.select(key, ts, value).groupBy(key).applyInPandas(one, f"{key} {dict(df.dtypes)[key]}, {SCHEMA}")
