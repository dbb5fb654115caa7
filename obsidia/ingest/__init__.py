"""Ingest: naming, normalisation, admission and de-duplication of decoded telemetry as DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FUTURE_NS, PAST_NS = 10 * 60 * 10**9, 2 * 3600 * 10**9
UNITS = {
    "d": "days", "h": "hours", "min": "minutes", "s": "seconds", "ms": "milliseconds", "us": "microseconds", "ns": "nanoseconds", "By": "bytes", "KiBy": "kibibytes", "MiBy": "mebibytes", "GiBy": "gibibytes", "TiBy": "tibibytes",
    "KBy": "kilobytes", "MBy": "megabytes", "GBy": "gigabytes", "TBy": "terabytes", "m": "meters", "V": "volts", "A": "amperes", "J": "joules", "W": "watts", "g": "grams", "Cel": "celsius", "Hz": "hertz", "%": "percent",
}
_PER = {"s": "second", "m": "minute", "min": "minute", "h": "hour", "d": "day", "w": "week", "mo": "month", "y": "year"}
RESERVED = ("service.namespace", "service.name", "service.instance.id")


def sanitised(name: Column, metric: bool = True) -> Column:
    """Every illegal character becomes an underscore, a leading digit too."""
    clean = F.regexp_replace(name, r"[^a-zA-Z0-9_:]" if metric else r"[^a-zA-Z0-9_]", "_")
    return F.regexp_replace(clean, r"^[0-9]", "_")


def unit_suffix(unit: Column, gauge: Column) -> Column:
    """Long form of a unit: annotations in braces are dropped, ``a/b`` is ``a_per_b``, 1 on a gauge is a ratio."""
    table = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    per = F.create_map(*[F.lit(x) for kv in _PER.items() for x in kv])
    bare = F.trim(F.regexp_replace(F.coalesce(unit, F.lit("")), r"\{[^}]*\}", ""))
    top, below = F.split_part(bare, F.lit("/"), F.lit(1)), F.split_part(bare, F.lit("/"), F.lit(2))
    long_top, long_below = F.coalesce(table[top], top), F.coalesce(per[below], table[below], below)
    joined = F.when(below != "", F.concat(F.when(top != "", F.concat(long_top, F.lit("_"))).otherwise(F.lit("")), F.lit("per_"), long_below)).otherwise(long_top)
    return sanitised(F.when(bare == "1", F.when(gauge, F.lit("ratio")).otherwise(F.lit(""))).otherwise(joined), False)


def family(name: Column, unit: Column, kind: Column, monotonic: Column) -> Column:
    """Metric family: the unit, then ``_total`` for monotonic sums, neither of them twice."""
    base, suffix = sanitised(name), unit_suffix(unit, kind == "gauge")
    counts = (kind == "sum") & monotonic
    bare = F.when(counts & base.endswith("_total"), F.substr(base, F.lit(1), F.length(base) - 6)).otherwise(base)
    with_unit = F.when((suffix == "") | bare.endswith(F.concat(F.lit("_"), suffix)), bare).otherwise(F.concat(bare, F.lit("_"), suffix))
    return F.when(counts, F.concat(with_unit, F.lit("_total"))).otherwise(with_unit)


def resource_labels(resource: Column, allowed: tuple[str, ...] = ()) -> Column:
    """``job`` and ``instance`` from the service's attributes, and other allowed ones under clean names."""
    job = F.concat_ws("/", resource["service.namespace"], resource["service.name"])
    base = F.map_filter(F.create_map(F.lit("job"), job, F.lit("instance"), resource["service.instance.id"]), lambda k, v: v.isNotNull() & (v != ""))
    others = F.transform_keys(F.map_filter(resource, lambda k, v: k.isin([a for a in allowed if a not in RESERVED])), lambda k, v: sanitised(k, False))
    return F.map_concat(base, others)


def admitted(df: DataFrame, now_ns: int, ts: str = "ts_ns", attrs: str | None = None) -> DataFrame:
    """Adds ``rejected``: null, or why a point may not enter."""
    t = F.col(ts)
    reason = F.when(t.isNull() | (t == 0), "ZeroTimestamp").when(t > now_ns + FUTURE_NS, "FutureSkew").when(t < now_ns - PAST_NS, "TooOld")
    if attrs:
        reason = F.coalesce(reason, F.when(F.size(attrs) > 64, "TooManyAttributes").when(F.exists(F.map_keys(attrs), lambda k: F.length(k) > 512), "NameTooLong").when(F.exists(F.map_values(attrs), lambda v: F.octet_length(v) > 4096), "ValueTooLong"))
    return df.withColumn("rejected", reason)


def explode_histogram(df: DataFrame) -> DataFrame:
    """``name, labels, ts_ns, bounds, counts, sum`` points as cumulative ``_bucket``, ``_sum`` and ``_count`` series.

    Points whose bounds are not finite and rising, or whose counts do not fit them, are left out.
    """
    n = F.size("bounds")
    rising = F.forall(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i >= n) | (F.try_element_at("bounds", i) < F.try_element_at("bounds", i + 1)))
    good = df.where((F.size("counts") == n + 1) & rising & F.forall("bounds", lambda b: ~F.isnan(b) & (F.abs(b) != float("inf"))))
    running = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0).cast("long"), lambda a, c: a + c))
    le = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.when(i > n, F.lit("+Inf")).otherwise(F.regexp_replace(F.try_element_at("bounds", i).cast("string"), r"\.0$", "")))
    buckets = F.transform(F.arrays_zip(le.alias("le"), running.alias("n")), lambda x: F.struct(F.lit("_bucket").alias("part"), x["le"].alias("le"), x["n"].cast("double").alias("value")))
    rest = F.array(F.struct(F.lit("_sum").alias("part"), F.lit(None).cast("string").alias("le"), F.col("sum").cast("double").alias("value")), F.struct(F.lit("_count").alias("part"), F.lit(None).cast("string").alias("le"), F.element_at(running, -1).cast("double").alias("value")))
    each = good.select("name", "labels", "ts_ns", F.explode(F.concat(buckets, rest)).alias("x"))
    labels = F.when(F.col("x.le").isNull(), F.col("labels")).otherwise(F.map_concat("labels", F.map_filter(F.create_map(F.lit("le"), F.col("x.le")), lambda k, v: v.isNotNull())))
    return each.select(F.concat("name", "x.part").alias("name"), labels.alias("labels"), "ts_ns", F.col("x.value").alias("value"))


def span_kind(kind: Column) -> Column:
    """Name of a span kind; unspecified is absent."""
    return F.when(kind == 1, "internal").when(kind == 2, "server").when(kind == 3, "client").when(kind == 4, "producer").when(kind == 5, "consumer")


def capped_exemplars(df: DataFrame, keys: list[str], every_ns: int = 10 * 10**9) -> DataFrame:
    """The newest exemplar of each series and slot."""
    slot = F.call_function("div", F.col("ts_ns"), F.lit(every_ns))
    by = Window.partitionBy(*keys, slot).orderBy(F.col("ts_ns").desc())
    return df.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")
