"""Decoded telemetry to rows of the signals: metric points by kind, summaries, exponential histograms, logs and spans.

Every function adds ``rejected``, null or the reason why a row may not enter, and leaves it to the caller to keep those
rows apart; nothing is dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsidia.ingest import FUTURE_NS, PAST_NS, admitted, family, resource_labels, sanitised, span_kind

CUMULATIVE = 2
MAX_NAME, MAX_ATTRIBUTES = 512, 64
#: Bit of a point's flags: the sender had no value, the series is stale.
NO_VALUE = 1


def label_value(value: Column) -> Column:
    """Text of ``struct<s string, b boolean, i long, d double, complex boolean>``; an absent value is empty."""
    number = F.regexp_replace(value["d"].cast("string"), r"\.0$", "")
    return F.coalesce(value["s"], value["b"].cast("string"), value["i"].cast("string"), number, F.lit(""))


def label_values(attrs: Column) -> Column:
    """Labels from attributes: clean names, values as text."""
    return F.map_from_entries(F.transform(F.map_entries(attrs), lambda e: F.struct(sanitised(e["key"], False).alias("key"), label_value(e["value"]).alias("value"))))


def _complex(attrs: Column) -> Column:
    return F.exists(F.map_values(attrs), lambda v: F.coalesce(v["complex"], F.lit(False)))


def points(df: DataFrame, now_ns: int, allowed: tuple[str, ...] = ()) -> DataFrame:
    """``name, labels, ts_ns, value, stale, rejected`` of number points.

    Input: ``name, unit, kind`` (gauge or sum), ``monotonic, temporality, resource map, attrs map<string, struct>,
    ts_ns, flags, value``. Sums must be cumulative. A point's own labels win over its resource's.
    """
    name = family(F.col("name"), F.col("unit"), F.col("kind"), F.col("monotonic"))
    labels = F.map_concat(F.map_filter(resource_labels(F.col("resource"), allowed), lambda k, v: ~F.array_contains(F.map_keys(label_values(F.col("attrs"))), k)), label_values(F.col("attrs")))
    shape = (
        F.when(F.length("name") == 0, "EmptyMetricName").when(F.octet_length("name") > MAX_NAME, "MetricNameTooLong").when(~F.col("kind").isin("gauge", "sum"), "UnsupportedKind")
        .when((F.col("kind") == "sum") & (F.coalesce("temporality", F.lit(0)) != CUMULATIVE), "NonCumulativeTemporality").when(F.size("attrs") > MAX_ATTRIBUTES, "TooManyAttributes").when(_complex(F.col("attrs")), "ComplexAttributeValue")
    )
    stale = F.coalesce(F.col("flags").bitwiseAND(NO_VALUE) != 0, F.lit(False))
    out = admitted(df.withColumn("_shape", shape), now_ns)
    return out.select(name.alias("name"), labels.alias("labels"), "ts_ns", F.when(stale, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), stale.alias("stale"), F.coalesce("_shape", "rejected").alias("rejected"))


def summaries(df: DataFrame) -> DataFrame:
    """``name, labels, ts_ns, quantiles array<struct<quantile,value>>, sum, count`` as one series per quantile, ``_sum``
    and ``_count``. Points with a quantile that is not finite or occurs twice have one row, rejected."""
    q = F.transform("quantiles", lambda x: x["quantile"])
    bad = F.when(F.exists(q, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "NonFiniteQuantile").when(F.size(F.array_distinct(q)) < F.size(q), "DuplicateQuantile")
    part = lambda suffix, quantile, value: F.struct(F.lit(suffix).alias("suffix"), quantile.alias("quantile"), value.cast("double").alias("value"))
    text = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    none = F.lit(None).cast("string")
    series = F.concat(F.transform("quantiles", lambda x: part("", text(x["quantile"]), x["value"])), F.array(part("_sum", none, F.col("sum")), part("_count", none, F.col("count"))))
    each = df.withColumn("rejected", bad).withColumn("x", F.explode(F.when(F.col("rejected").isNull(), series).otherwise(F.array(part("", none, F.lit(None))))))
    more = F.map_filter(F.create_map(F.lit("quantile"), F.col("x.quantile")), lambda k, v: v.isNotNull())
    return each.select(F.concat("name", "x.suffix").alias("name"), F.map_concat("labels", more).alias("labels"), "ts_ns", "x.value", "rejected")


def exponential_histograms(df: DataFrame) -> DataFrame:
    """``name, labels, ts_ns, hist, rejected``: native histograms from ``scale, zero_threshold, zero_count, count, sum,
    pos_offset, pos array<long>, neg_offset, neg array<long>, temporality``.

    A bucket's index is its offset plus one plus its place, so that bucket i ends at ``base ** i``. The count may not be
    less than what the buckets hold.
    """
    total = lambda c: F.aggregate(F.coalesce(c, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    buckets = lambda offset, counts: F.map_from_entries(F.transform(F.coalesce(counts, F.array().cast("array<bigint>")), lambda x, i: F.struct((offset + i + 1).cast("int").alias("key"), x.cast("double").alias("value"))))
    rejected = F.when(F.coalesce("temporality", F.lit(0)) != CUMULATIVE, "NonCumulativeTemporality").when(F.col("scale") <= -53, "NativeHistogramScaleUnsupported").when(F.col("count") < F.col("zero_count") + total(F.col("pos")) + total(F.col("neg")), "NativeHistogramCountMismatch")
    hist = F.struct(
        F.col("scale").cast("int").alias("scale"), F.col("zero_threshold").cast("double").alias("zero_threshold"), F.col("zero_count").cast("double").alias("zero_count"), F.col("count").cast("double").alias("count"), F.col("sum").cast("double").alias("sum"),
        buckets(F.coalesce("pos_offset", F.lit(0)), F.col("pos")).alias("pos"), buckets(F.coalesce("neg_offset", F.lit(0)), F.col("neg")).alias("neg"), F.array().cast("array<double>").alias("custom"), F.lit("unknown").alias("hint"),
    )
    return df.select("name", "labels", "ts_ns", hist.alias("hist"), rejected.alias("rejected"))


def _whole_id(value: Column, size: int) -> Column:
    """Hex of a binary id of exactly so many bytes."""
    return F.when(F.octet_length(value) == size, F.lower(F.hex(value)))


def logs(df: DataFrame, now_ns: int) -> DataFrame:
    """``ts_ns, observed_ts_ns, severity_num, severity_text, body, trace_id, span_id, flags, attrs, rejected``.

    Input: ``time_ns, observed_ns, severity_number, severity_text, body, trace_id binary, span_id binary, flags,
    resource map, attrs map<string, struct>``. A missing time is the observed one, a missing one of those the time of
    ingest; ids of a wrong length are absent; severities beyond a byte are 0. A record's attributes win.
    """
    observed = F.coalesce("observed_ns", F.lit(0))
    ts = F.when(F.coalesce("time_ns", F.lit(0)) != 0, F.col("time_ns")).when(observed != 0, observed).otherwise(F.lit(now_ns))
    own = F.map_from_entries(F.transform(F.map_entries("attrs"), lambda e: F.struct(e["key"].alias("key"), label_value(e["value"]).alias("value"))))
    attrs = F.map_concat(F.map_filter("resource", lambda k, v: ~F.array_contains(F.map_keys("attrs"), k)), own)
    rejected = F.when(ts > now_ns + FUTURE_NS, "FutureSkew").when(ts < now_ns - PAST_NS, "TooOld").when(_complex(F.col("attrs")), "ComplexAttributeValue")
    severity = F.when(F.col("severity_number").between(0, 255), F.col("severity_number")).otherwise(0).cast("smallint")
    return df.select(
        ts.alias("ts_ns"), observed.alias("observed_ts_ns"), severity.alias("severity_num"), F.coalesce("severity_text", F.lit("")).alias("severity_text"), "body",
        _whole_id(F.col("trace_id"), 16).alias("trace_id"), _whole_id(F.col("span_id"), 8).alias("span_id"), "flags", attrs.alias("attrs"), rejected.alias("rejected"),
    )


def spans(df: DataFrame, now_ns: int) -> DataFrame:
    """``trace_id, span_id, parent_span_id, name, start_ns, end_ns, status_code, status_message, attrs, rejected``.

    Input: binary ids, ``name, start_ns, end_ns, kind, status_code, status_message, events string, resource map,
    attrs map``. Unknown status codes are unset; the kind and the raw events go to ``_kind`` and ``_events_raw``, which
    a sender's attributes of those names don't replace; a span's attributes win over its resource's.
    """
    ids = (F.octet_length("trace_id") == 16) & (F.octet_length("span_id") == 8)
    rejected = F.when(~F.coalesce(ids, F.lit(False)), "InvalidId").when(F.col("start_ns") > F.col("end_ns"), "EndsBeforeStart").when(F.col("start_ns") > now_ns + FUTURE_NS, "FutureSkew").when(F.col("end_ns") < now_ns - PAST_NS, "TooOld")
    reserved = F.map_filter(F.create_map(F.lit("_kind"), span_kind(F.col("kind")), F.lit("_events_raw"), F.col("events")), lambda k, v: v.isNotNull())
    sent = F.map_concat(F.map_filter("resource", lambda k, v: ~F.array_contains(F.map_keys("attrs"), k)), "attrs")
    attrs = F.map_concat(F.map_filter(sent, lambda k, v: ~k.isin("_kind", "_events_raw")), reserved)
    status = F.when(F.col("status_code").isin(1, 2), F.col("status_code")).otherwise(0).cast("smallint")
    return df.select(
        _whole_id(F.col("trace_id"), 16).alias("trace_id"), _whole_id(F.col("span_id"), 8).alias("span_id"), _whole_id(F.col("parent_span_id"), 8).alias("parent_span_id"), "name", "start_ns", "end_ns",
        status.alias("status_code"), "status_message", attrs.alias("attrs"), rejected.alias("rejected"),
    )
