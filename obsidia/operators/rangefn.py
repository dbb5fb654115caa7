"""Range-vector functions as aggregations over (series, step)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsidia.functions.instant import divide

#: Functions that look at a sample's predecessor in its series.
WITH_PREVIOUS = {"rate", "increase", "irate", "idelta", "resets", "changes"}
OVER_TIME = {"avg", "min", "max", "sum", "count", "stddev", "stdvar", "quantile", "present", "last"}
NAMES = WITH_PREVIOUS | {"delta", "deriv", "predict_linear"} | {f"{x}_over_time" for x in OVER_TIME}
#: Position of the range vector among the arguments.
RANGE_ARG = {"quantile_over_time": 1}


def with_previous(samples: DataFrame) -> DataFrame:
    """Adds each sample's predecessor; markers must be gone."""
    by = Window.partitionBy("sig").orderBy("ts_ns")
    return samples.withColumns({"prev_v": F.lag("value").over(by), "prev_ts": F.lag("ts_ns").over(by)})


def quantile(v: Column, q: Column | float) -> Column:
    """Linear quantile in which NaN sorts lowest: Spark's, where it sorts highest, seen from the other side."""
    q = F.lit(float(q)) if not isinstance(q, Column) else q
    if_in = lambda x: -F.percentile(-v, 1 - x)
    return if_in(q)


def bounded_quantile(v: Column, q: float) -> Column:
    """``quantile`` with its values outside 0 to 1."""
    if math.isnan(q):
        return F.when(F.count(v) > 0, F.lit(math.nan))
    if q < 0 or q > 1:
        return F.when(F.count(v) > 0, F.lit(-math.inf if q < 0 else math.inf))
    return quantile(v, q)


def skip_nan(f, v: Column) -> Column:
    """min or max that heeds NaN only if there is nothing else."""
    return F.coalesce(f(F.when(~F.isnan(v), v)), f(v))


def variance(f, v: Column) -> Column:
    """Population spread; any NaN or infinity makes it NaN."""
    odd = F.max(F.isnan(v) | (F.abs(v) == math.inf))
    return F.when(odd, F.lit(math.nan)).otherwise(f(v))


def _extrapolated(windows: DataFrame, counter: bool, per_second: bool, range_ns: int) -> DataFrame:
    drop = F.when(F.col("value") < F.col("prev_v"), F.col("prev_v")).otherwise(0.0) if counter else F.lit(0.0)
    w = windows.withColumn("drop", drop)
    a = w.groupBy("k", "sig").agg(
        F.count("*").alias("n"), F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"), F.first("t_ns").alias("t_ns"),
        F.min_by("value", "ts_ns").alias("v0"), F.max_by("value", "ts_ns").alias("v1"), (F.sum("drop") - F.min_by("drop", "ts_ns")).alias("lost"),
    ).where("n > 1")
    ms = lambda x: F.call_function("div", x, F.lit(1_000_000)) / 1000.0
    risen = F.col("v1") - F.col("v0") + F.col("lost")
    a = a.withColumns({"risen": risen, "before": ms(F.col("t_ns") - range_ns - F.col("t0")) * -1, "after": ms(F.col("t_ns") - F.col("t1")), "span": ms(F.col("t1") - F.col("t0"))})
    a = a.withColumn("mean", F.col("span") / (F.col("n") - 1))
    before = F.col("before")
    if counter:
        to_zero = divide(F.col("span") * F.col("v0"), F.col("risen"))
        before = F.when((F.col("risen") > 0) & (F.col("v0") >= 0) & (to_zero < before), to_zero).otherwise(before)
    edge = lambda x: F.when(x < F.col("mean") * 1.1, x).otherwise(F.col("mean") / 2)
    factor = divide(F.col("span") + edge(before) + edge(F.col("after")), F.col("span"))
    value = F.col("risen") * factor
    return a.select("k", "sig", (value / (range_ns / 1e9) if per_second else value).alias("value"))


def apply(name: str, windows: DataFrame, range_ns: int, param: float | None) -> DataFrame:
    """``k, sig, value`` of one function; ``windows`` has ``k, t_ns, sig, ts_ns, value`` and for some ``prev_v, prev_ts``.

    ``param`` is the quantile, or the seconds that predict_linear looks ahead.
    """
    v, by = F.col("value"), windows.groupBy("k", "sig")
    if name in ("rate", "increase", "delta"):
        return _extrapolated(windows, name != "delta", name == "rate", range_ns)
    inside = F.col("prev_ts") > F.col("t_ns") - range_ns
    if name in ("irate", "idelta"):
        last = by.agg(F.max_by(F.struct("value", "prev_v", "ts_ns", F.when(inside, F.col("prev_ts")).alias("prev_ts")), "ts_ns").alias("x")).where("x.prev_ts is not null and x.ts_ns > x.prev_ts")
        change = F.col("x.value") - F.col("x.prev_v")
        if name == "irate":
            change = F.when(F.col("x.value") < F.col("x.prev_v"), F.col("x.value")).otherwise(change) / ((F.col("x.ts_ns") - F.col("x.prev_ts")) / 1e9)
        return last.select("k", "sig", change.alias("value"))
    if name in ("resets", "changes"):
        p = F.col("prev_v")
        both = F.isnan(v) & F.isnan(p)
        hit = (~F.isnan(v) & ~F.isnan(p) & (v < p)) if name == "resets" else ((v != p) & ~both)
        return by.agg(F.sum(F.when(inside & hit, 1.0).otherwise(0.0)).alias("value"))
    if name in ("deriv", "predict_linear"):
        w = windows.withColumn("x", (F.col("ts_ns") - F.col("t_ns")) / 1e9)
        a = w.groupBy("k", "sig").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("base")).where("n > 1")
        flat = F.col("low") == F.col("high")
        odd = F.abs(F.col("low")) == math.inf
        slope = F.when(flat & odd, F.lit(math.nan)).when(flat, 0.0).otherwise(F.col("slope"))
        if name == "deriv":
            return a.select("k", "sig", slope.alias("value"))
        return a.select("k", "sig", (slope * param + F.when(flat & odd, F.lit(math.nan)).when(flat, F.col("low")).otherwise(F.col("base"))).alias("value"))
    kind = name.removesuffix("_over_time")
    value = {
        "avg": lambda: F.avg(v), "min": lambda: skip_nan(F.min, v), "max": lambda: skip_nan(F.max, v), "sum": lambda: F.sum(v), "count": lambda: F.count(v).cast("double"),
        "stddev": lambda: variance(F.stddev_pop, v), "stdvar": lambda: variance(F.var_pop, v), "quantile": lambda: bounded_quantile(v, param),
        "present": lambda: F.max(F.lit(1.0)), "last": lambda: F.max_by(v, F.col("ts_ns")),
    }[kind]()
    return by.agg(value.alias("value"))
