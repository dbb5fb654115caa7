"""The engine's tables, derived from the star-schema and event tables of a directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsidia.functions import labels as L
from obsidia.sources.series import SeriesSource

BOUNDS = (10.0, 50.0, 100.0, 200.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since the epoch of a time without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def _labelled(df: DataFrame, **labels: Column) -> DataFrame:
    pairs = [x for k, v in labels.items() for x in (F.lit(k), v)]
    return df.select(F.create_map(*pairs).alias("labels"), "ts_ns", "value", F.lit(False).alias("stale"), "ts")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 4).cast("string").alias("shard"), (micros("ts") * 1000).alias("ts_ns"), "value")


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_value``: each event's value."""
    return _labelled(_events(spark, sf_dir), event_type=F.col("event_type"), shard=F.col("shard"))


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events_value_total``: running sum of values, which starts again whenever it passes a thousand."""
    by = Window.partitionBy("event_type", "shard").orderBy("ts_ns", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).over(by) % 100_000
    return _labelled(_events(spark, sf_dir).withColumn("value", cents / 100.0), event_type=F.col("event_type"), shard=F.col("shard"))


def bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value_bucket``: running counts of values up to each bound, by event type."""
    by = Window.partitionBy("event_type").orderBy("ts_ns", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = _events(spark, sf_dir)
    counts = [F.sum((F.col("value") <= b).cast("long")).over(by) for b in BOUNDS] + [F.count("*").over(by)]
    names = [f"{b:g}" for b in BOUNDS] + ["+Inf"]
    each = e.select("event_type", "ts_ns", "ts", F.array(*[F.struct(F.lit(n).alias("le"), c.cast("double").alias("value")) for n, c in zip(names, counts)]).alias("b")).select("event_type", "ts_ns", "ts", F.explode("b").alias("b"))
    return _labelled(each.select("event_type", "ts_ns", "ts", "b.le", "b.value"), event_type=F.col("event_type"), le=F.col("le"))


def flaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flaky_value``: each event's value, every fourth one a stale marker."""
    e = _labelled(_events(spark, sf_dir).withColumn("value", F.struct("event_id", "value")), event_type=F.col("event_type"), shard=F.col("shard"))
    stale = F.col("value.event_id") % 4 == 0
    return e.select("labels", "ts_ns", F.when(stale, F.lit(float("nan"))).otherwise(F.col("value.value")).alias("value"), stale.alias("stale"), "ts")


def native_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``value_native``: at every full hour a native histogram, of base 2, of the positive values in it by event type."""
    hour = (F.call_function("div", F.col("ts_ns"), F.lit(3600 * 10**9)) + 1) * (3600 * 10**9)
    e = _events(spark, sf_dir).where("value > 0").select("event_type", hour.alias("ts_ns"), F.ceil(F.log2("value")).cast("int").alias("i"), "value")
    each = e.groupBy("event_type", "ts_ns", "i").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("s"))
    one = each.groupBy("event_type", "ts_ns").agg(F.sum("n").alias("count"), F.sum("s").alias("sum"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("i", "n")))).alias("pos"))
    none = F.lit(0.0)
    hist = F.struct(F.lit(0).alias("scale"), none.alias("zero_threshold"), none.alias("zero_count"), "count", "sum", "pos", F.expr("map()").cast("map<int,double>").alias("neg"), F.array().cast("array<double>").alias("custom"), F.lit("gauge").alias("hint"))
    return one.select(F.create_map(F.lit("event_type"), F.col("event_type")).alias("labels"), "ts_ns", hist.alias("hist"), F.lit(False).alias("stale"))


def metrics(spark: SparkSession, sf_dir: str) -> SeriesSource:
    """PromQL source over the metrics."""
    return SeriesSource({"flaky_value": lambda: flaky(spark, sf_dir), "event_value": lambda: gauge(spark, sf_dir), "events_value_total": lambda: counter(spark, sf_dir), "value_bucket": lambda: bucket(spark, sf_dir)}, {"value_native": lambda: native_hours(spark, sf_dir)})


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL table ``samples`` of the gauge."""
    e = table(spark, sf_dir, "events")
    labels = F.create_map(F.lit("__name__"), F.lit("event_value"), F.lit("event_type"), F.col("event_type"), F.lit("shard"), (F.col("user_id") % 4).cast("string"))
    return e.select((micros("ts") * 1000).alias("ts_ns"), "ts", "value", F.md5(L.sig_of(labels)).alias("series_id"), labels.alias("labels"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL table ``logs`` of the events, with the declared whole-number attribute ``k``."""
    e, error = table(spark, sf_dir, "events"), F.col("event_type") == "error"
    k = F.get_json_object("props", "$.k")
    attrs = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"), F.lit("k"), k)
    return e.select(
        (micros("ts") * 1000).alias("ts_ns"), "ts", F.col("ts").alias("observed_ts"), F.when(error, 17).otherwise(9).cast("smallint").alias("severity_num"), F.when(error, "ERROR").otherwise("INFO").alias("severity_text"),
        F.concat("event_type", F.lit(" "), "props").alias("body"), F.md5(F.col("event_id").cast("string")).alias("trace_id"), F.lit(None).cast("string").alias("span_id"), F.lit(0).cast("bigint").alias("flags"), attrs.alias("attrs"), F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"),
    )


def logs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL table of the documents as log bodies."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("body"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("attrs"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL table ``spans`` of the line items under their orders."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    start, end = F.least("o_orderdate", "l_shipdate"), F.greatest("o_orderdate", "l_shipdate")
    rows = j.select(
        F.md5(F.col("o_orderkey").cast("string")).alias("trace_id"), F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber")), 1, 16).alias("span_id"),
        F.when(F.col("l_linenumber") > 1, F.substring(F.md5(F.concat(F.col("l_orderkey").cast("string"), F.lit("-1"))), 1, 16)).alias("parent_span_id"),
        F.concat("l_returnflag", "l_linestatus").alias("name"), start.alias("start_ts"), end.alias("end_ts"),
        F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0).cast("smallint").alias("status_code"),
        F.when(F.col("l_returnflag") == "R", "returned").alias("status_message"),
        F.create_map(F.lit("service.name"), F.col("o_orderpriority"), F.lit("supplier"), F.col("l_suppkey").cast("string")).alias("attrs"), F.col("o_orderpriority").alias("service_name"),
    )
    return rows.withColumn("duration_ns", (micros("end_ts") - micros("start_ts")) * 1000)


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events with their trace, the newest per series and ten seconds."""
    e = _events(spark, sf_dir).where("event_type = 'error'")
    slot = F.call_function("div", F.col("ts_ns"), F.lit(10_000_000_000))
    best = e.groupBy("event_type", "shard", slot.alias("slot")).agg(F.max(F.struct("ts_ns", "event_id", "value")).alias("x"))
    return best.select("event_type", "shard", "x.ts_ns", "x.value", F.md5(F.col("x.event_id").cast("string")).alias("trace_id"))


def metadata(spark: SparkSession) -> DataFrame:
    """Type, help and unit of each metric."""
    rows = [("event_value", "gauge", "Value of an event", ""), ("events_value_total", "counter", "Sum of values", ""), ("value_bucket", "histogram", "Values by bound", "")]
    return spark.createDataFrame(rows, "metric string, type string, help string, unit string")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL table ``alerts``: a record per error event of a rule per user, which fires and resolves in turn."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    user = F.col("user_id").cast("string")
    state = F.when(F.col("event_id") % 2 == 0, "firing").otherwise("resolved")
    attrs = F.create_map(F.lit("label.user"), user, F.lit("annotation.summary"), F.concat(F.lit("errors of "), user))
    return e.select((micros("ts") * 1000).alias("ts_ns"), "ts", F.md5(user).alias("alert_id"), F.concat(F.lit("errors-"), (F.col("user_id") % 4).cast("string")).alias("rule_id"), state.alias("state"), (F.col("user_id") % 3).cast("bigint").alias("generation"), attrs.alias("attrs"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL table ``audit``: legal holds put on and lifted, one record per order."""
    o = table(spark, sf_dir, "orders")
    op = F.when(F.col("o_orderstatus") == "O", "put").otherwise("lift")
    attrs = F.create_map(F.lit("kind"), F.lit("legal_hold"), F.lit("hold.op"), op, F.lit("hold.scope"), F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")), F.lit("hold.reason"), F.col("o_orderpriority"))
    return o.select((micros("o_orderdate") * 1000).alias("ts_ns"), F.lit("INFO").alias("severity_text"), F.concat(F.lit("legal hold "), op).alias("body"), attrs.alias("attrs"))
