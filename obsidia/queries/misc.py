"""Queries of de-duplication, maintenance, analytics, alerting and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsidia import alerting, ingest, maintain
from obsidia.analytics.change_point import change_points
from obsidia.analytics.summary import summary
from obsidia.engine import Engine
from obsidia.ingest import normalise
from obsidia.functions import labels as L
from obsidia.queries.promql import _EVENTS, END, H, START
from obsidia.sources import views
from obsidia.sources.series import deduplicated

_NOW = END
_RULE = alerting.Rule("busy", "sum(count_over_time(event_value[6h]))", threshold=("Gt", 90.0), for_ns=12 * H)
_ERASE = [maintain.Erasure({"event_type": "error"}, START, END), maintain.Erasure({"shard": "2"})]


def dedup_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that repeat a key: the greatest provenance wins."""
    return deduplicated(views.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"], "l_extendedprice")


def erase_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = maintain.erase(views.samples(spark, sf_dir), _ERASE)
    return left.select("ts_ns", "series_id", "value")


def retention_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.expired_hours(views.samples(spark, sf_dir), _NOW, 3 * 24 * H)


def retention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.retain(views.samples(spark, sf_dir), _NOW, 3 * 24 * H).select("ts_ns", "series_id", "value")


def compact_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct samples per hour bucket, which compaction must keep."""
    s = views.samples(spark, sf_dir)
    return s.groupBy(maintain.hour_of().alias("hour")).agg(F.count("*").alias("rows"), F.countDistinct("series_id", "ts_ns").alias("samples"))


def analytics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary(views.samples(spark, sf_dir), ["series_id"], percentiles=(50, 95))
    return s.select("series_id", "n", "nan_excluded", *[F.round(c, 6).alias(c) for c in ("median", "mad", "variance", "stddev", "p50", "p95")])


def analytics_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points more than six robust deviations from their series' median."""
    s = views.samples(spark, sf_dir)
    stats = summary(s, ["series_id"], percentiles=()).select("series_id", "median", "mad")
    z = (F.col("value") - F.col("median")) / (F.col("mad") * 1.4826)
    return s.join(stats, "series_id").where("mad > 0").select("series_id", "ts_ns", F.round(z, 6).alias("z")).where("abs(z) > 6")


def analytics_change_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_points(views.samples(spark, sf_dir), "series_id")


def alert_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerting.active_steps(Engine.open(spark, sf_dir).promql_range(_RULE.query, START, END, 6 * H), _RULE)


def alert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerting.history(alert_active(spark, sf_dir), _RULE.for_ns)


def alert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = alert_history(spark, sf_dir).select(F.lit(_RULE.rule_id).alias("alert_id"), "ts_ns", "state")
    return alerting.latest(records)


def ingest_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family names over a table of names, units and kinds made of parts."""
    p = views.table(spark, sf_dir, "part")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("By", "s", "1", "By/s", "{req}", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    kind = F.when(F.col("p_partkey") % 2 == 0, "gauge").otherwise("sum")
    return p.select("p_partkey", ingest.family(F.concat(F.lower("p_brand"), F.lit(".size")), unit, kind, F.col("p_partkey") % 3 == 0).alias("family"))


def ingest_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ingest.admitted(views.samples(spark, sf_dir), _NOW)
    return s.groupBy(F.coalesce("rejected", F.lit("admitted")).alias("outcome")).agg(F.count("*").alias("n"))


def ingest_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' totals by day as histogram points, exploded."""
    o = views.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*[F.sum(F.expr(f"int(o_totalprice > {a} and o_totalprice <= {b})")).alias(f"c{i}") for i, (a, b) in enumerate(((-1, 100000), (100000, 300000), (300000, 1e18)))], F.sum("o_totalprice").alias("sum"))
    points = o.select(F.lit("total").alias("name"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("labels"), F.lit(0).cast("long").alias("ts_ns"), F.array(F.lit(100000.0), F.lit(300000.0)).alias("bounds"), F.array("c0", "c1", "c2").alias("counts"), "sum")
    return ingest.explode_histogram(points).select("name", L.label(L.sig_of(F.col("labels")), "status").alias("status"), F.coalesce(F.col("labels")["le"], F.lit("")).alias("le"), F.round("value", 2).alias("value"))


def ingest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decoded number points of both kinds, some stale, some of a wrong temporality."""
    e, i = views.table(spark, sf_dir, "events"), F.col("event_id")
    value = lambda s, n: F.struct(s.alias("s"), F.lit(None).cast("boolean").alias("b"), n.alias("i"), F.lit(None).cast("double").alias("d"), F.lit(False).alias("complex"))
    attrs = F.create_map(F.lit("event.type"), value(F.col("event_type"), F.lit(None).cast("bigint")), F.lit("9k"), value(F.lit(None).cast("string"), i % 4))
    resource = F.create_map(F.lit("service.namespace"), F.lit("shop"), F.lit("service.name"), F.lit("web"), F.lit("service.instance.id"), F.col("user_id").cast("string"))
    kind = F.when(i % 2 == 0, "gauge").otherwise("sum")
    rows = e.select(F.lit("http.latency").alias("name"), F.lit("ms").alias("unit"), kind.alias("kind"), F.lit(True).alias("monotonic"), (i % 3).cast("int").alias("temporality"), resource.alias("resource"), attrs.alias("attrs"), (views.micros("ts") * 1000).alias("ts_ns"), (i % 5 == 0).cast("int").alias("flags"), "value")
    return normalise.points(rows, _NOW).select("name", L.sig_of(F.col("labels")).alias("labels"), "ts_ns", F.when(~F.col("stale"), F.col("value")).alias("value"), "stale", "rejected")


def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' totals by status as summaries; one names a quantile twice."""
    o = views.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.sum("o_totalprice").alias("sum"), F.count("*").alias("count"))
    second = F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.99)
    q = F.array(F.struct(F.lit(0.5).alias("quantile"), F.col("lo").cast("double").alias("value")), F.struct(second.alias("quantile"), F.col("hi").cast("double").alias("value")))
    rows = o.select(F.lit("total").alias("name"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("labels"), F.lit(0).cast("long").alias("ts_ns"), q.alias("quantiles"), "sum", "count")
    return normalise.summaries(rows).select("name", F.col("labels")["status"].alias("status"), F.coalesce(F.col("labels")["quantile"], F.lit("")).alias("quantile"), F.round("value", 2).alias("value"), "rejected")


def ingest_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as exponential histograms; every seventh one counts less than its buckets hold."""
    p, k, n = views.table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size").cast("long")
    rows = p.select(k.cast("string").alias("name"), F.create_map(F.lit("k"), k).alias("labels"), F.lit(0).cast("long").alias("ts_ns"), F.lit(2).alias("temporality"), F.lit(0).alias("scale"), F.lit(0.0).alias("zero_threshold"), F.lit(1).alias("zero_count"), (n + 4 - (k % 7 == 0).cast("long")).alias("count"), F.lit(1.5).alias("sum"),
                    (k % 5 - 2).cast("int").alias("pos_offset"), F.array(n, F.lit(1).cast("long")).alias("pos"), F.lit(None).cast("int").alias("neg_offset"), F.array(F.lit(2).cast("long")).alias("neg"))
    out = normalise.exponential_histograms(rows)
    return out.select("name", F.explode("hist.pos").alias("i", "n"), "rejected", F.col("hist.count").alias("count"), F.col("hist.neg")[1].alias("neg1"))


def ingest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as decoded log records with missing times, odd severities and short ids."""
    e, i, ts = views.table(spark, sf_dir, "events"), F.col("event_id"), views.micros("ts") * 1000
    value = F.struct(F.col("event_type").alias("s"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"), F.lit(False).alias("complex"))
    trace = F.when(i % 2 == 0, F.unhex(F.md5(i.cast("string")))).otherwise(F.unhex(F.lit("0102")))
    rows = e.select(F.when(i % 3 == 0, 0).otherwise(ts).alias("time_ns"), F.when(i % 6 == 0, None).otherwise(ts).alias("observed_ns"), (i % 300).cast("int").alias("severity_number"), F.lit(None).cast("string").alias("severity_text"), F.col("props").alias("body"), trace.alias("trace_id"), F.lit(None).cast("binary").alias("span_id"), F.lit(0).alias("flags"),
                    F.create_map(F.lit("kind"), F.lit("resource"), F.lit("host"), F.lit("h")).alias("resource"), F.create_map(F.lit("kind"), value).alias("attrs"))
    out = normalise.logs(rows, _NOW)
    return out.select("ts_ns", "observed_ts_ns", F.col("severity_num").cast("int").alias("severity_num"), "severity_text", "body", "trace_id", F.col("attrs")["kind"].alias("kind"), F.col("attrs")["host"].alias("host"), "rejected")


def ingest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as decoded spans with every kind, unknown statuses and, for some, an id that is too short."""
    li, n = views.table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    trace, span = F.md5(F.col("l_orderkey").cast("string")), F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber")), 1, 16)
    start = views.micros("l_shipdate") * 1000
    rows = li.select(F.unhex(trace).alias("trace_id"), F.unhex(F.when(n == 7, "00").otherwise(span)).alias("span_id"), F.lit(None).cast("binary").alias("parent_span_id"), F.col("l_linestatus").alias("name"), start.alias("start_ns"), (start + n).alias("end_ns"), (n % 7).cast("int").alias("kind"), (n % 4).cast("int").alias("status_code"),
                     F.lit(None).cast("string").alias("status_message"), F.lit("[]").alias("events"), F.create_map(F.lit("_kind"), F.lit("forged"), F.lit("host"), F.lit("r")).alias("resource"), F.create_map(F.lit("host"), F.col("l_returnflag")).alias("attrs"))
    out = normalise.spans(rows, 900_000_000 * 10**9)
    return out.select("trace_id", "span_id", "name", "start_ns", F.col("status_code").cast("int").alias("status_code"), F.col("attrs")["_kind"].alias("kind"), F.col("attrs")["_events_raw"].alias("events"), F.col("attrs")["host"].alias("host"), "rejected")


def exemplar_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.exemplars(spark, sf_dir)


_S = "WITH s AS (SELECT epoch_us(ts) * 1000 AS ts_ns, value, event_type, CAST(user_id % 4 AS VARCHAR) AS shard, md5('{\"__name__\":\"event_value\",\"event_type\":\"' || event_type || '\",\"shard\":\"' || user_id % 4 || '\"}') AS series_id FROM events)"
_STATS = "m AS (SELECT series_id, count(*) AS n, CAST(0 AS BIGINT) AS nan_excluded, median(value) AS median, var_pop(value) AS variance, stddev_pop(value) AS stddev, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM s GROUP BY series_id), d AS (SELECT series_id, median(abs(value - median)) AS mad FROM s JOIN m USING (series_id) GROUP BY series_id)"
_STEPS = f"""steps AS (SELECT g AS ts_ns, count(*) > 90 AS active FROM (SELECT {START} + i * {6 * H} AS g FROM range({(END - START) // (6 * H) + 1}) r(i)) JOIN e ON t > g - {6 * H} AND t <= g GROUP BY g)"""
_HISTORY = f"""WITH {_EVENTS}, {_STEPS},
a AS (SELECT *, coalesce(lag(active) OVER (ORDER BY ts_ns), false) <> active AS change FROM steps),
b AS (SELECT *, sum(CAST(change AS INTEGER)) OVER (ORDER BY ts_ns) AS run FROM a),
c AS (SELECT *, CASE WHEN NOT active THEN 'inactive' WHEN ts_ns - min(ts_ns) OVER (PARTITION BY run) >= {12 * H} THEN 'firing' ELSE 'pending' END AS st FROM b),
d AS (SELECT *, coalesce(lag(st) OVER (ORDER BY ts_ns), 'inactive') AS prior FROM c),
h AS (SELECT ts_ns, CASE WHEN st = 'inactive' AND prior = 'firing' THEN 'resolved' ELSE st END AS state FROM d WHERE st <> prior)"""

ORACLE = {
    "dedup_samples": "SELECT l_orderkey, l_linenumber, arg_max(l_extendedprice, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_extendedprice FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "erase_samples": f"{_S} SELECT ts_ns, series_id, value FROM s WHERE NOT (event_type = 'error' AND ts_ns >= {START} AND ts_ns < {END}) AND shard <> '2'",
    "retention_hours": f"{_S} SELECT ts_ns // {H} AS hour, max(ts_ns) AS newest, count(*) AS rows FROM s GROUP BY 1 HAVING max(ts_ns) < {_NOW - 3 * 24 * H}",
    "retention_rows": f"{_S} SELECT ts_ns, series_id, value FROM s WHERE ts_ns // {H} NOT IN (SELECT ts_ns // {H} FROM s GROUP BY 1 HAVING max(ts_ns) < {_NOW - 3 * 24 * H})",
    "compact_plan": f"{_S} SELECT ts_ns // {H} AS hour, count(*) AS rows, count(DISTINCT (series_id, ts_ns)) AS samples FROM s GROUP BY 1",
    "analytics_summary": f"{_S}, {_STATS} SELECT series_id, n, nan_excluded, round(median, 6) AS median, round(mad, 6) AS mad, round(variance, 6) AS variance, round(stddev, 6) AS stddev, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM m JOIN d USING (series_id)",
    "analytics_spikes": f"{_S}, {_STATS} SELECT series_id, ts_ns, round((value - median) / (mad * 1.4826), 6) AS z FROM s JOIN m USING (series_id) JOIN d USING (series_id) WHERE mad > 0 AND abs((value - median) / (mad * 1.4826)) > 6",
    "alert_active": f"WITH {_EVENTS}, {_STEPS} SELECT ts_ns, active FROM steps",
    "alert_history": f"{_HISTORY} SELECT * FROM h",
    "alert_latest": f"{_HISTORY} SELECT 'busy' AS alert_id, max(ts_ns) AS ts_ns, arg_max(state, ts_ns) AS state FROM h HAVING count(*) > 0",
    "ingest_family": """WITH p AS (SELECT p_partkey, regexp_replace(lower(p_brand) || '.size', '[^a-zA-Z0-9_:]', '_', 'g') AS b, p_partkey % 2 = 0 AS gauge, p_partkey % 2 = 1 AND p_partkey % 3 = 0 AS counts FROM part),
q AS (SELECT *, CASE p_partkey % 6 WHEN 0 THEN 'bytes' WHEN 1 THEN 'seconds' WHEN 2 THEN (CASE WHEN gauge THEN 'ratio' ELSE '' END) WHEN 3 THEN 'bytes_per_second' ELSE '' END AS u FROM p)
SELECT p_partkey, b || CASE WHEN u = '' THEN '' ELSE '_' || u END || CASE WHEN counts THEN '_total' ELSE '' END AS family FROM q""",
    "ingest_admission": f"{_S} SELECT CASE WHEN ts_ns > {_NOW} + 600000000000 THEN 'FutureSkew' WHEN ts_ns < {_NOW} - 7200000000000 THEN 'TooOld' ELSE 'admitted' END AS outcome, count(*) AS n FROM s GROUP BY 1",
    "ingest_histogram": """WITH h AS (SELECT o_orderstatus AS status, count(*) FILTER (o_totalprice <= 100000) AS a, count(*) FILTER (o_totalprice <= 300000) AS b, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1)
SELECT name, status, le, round(CAST(value AS DOUBLE), 2) AS value FROM (SELECT 'total_bucket' AS name, status, '100000' AS le, a AS value FROM h UNION ALL SELECT 'total_bucket', status, '300000', b FROM h UNION ALL SELECT 'total_bucket', status, '+Inf', n FROM h UNION ALL SELECT 'total_count', status, '', n FROM h UNION ALL SELECT 'total_sum', status, '', s FROM h)""",
    "ingest_points": f"""WITH e AS (SELECT *, epoch_us(ts) * 1000 AS ts_ns FROM events) SELECT 'http_latency_milliseconds' || CASE WHEN event_id % 2 = 0 THEN '' ELSE '_total' END AS name, '{{"_k":"' || event_id % 4 || '","event_type":"' || event_type || '","instance":"' || user_id || '","job":"shop/web"}}' AS labels, ts_ns,
CASE WHEN event_id % 5 <> 0 THEN value END AS value, event_id % 5 = 0 AS stale, CASE WHEN event_id % 2 = 1 AND event_id % 3 <> 2 THEN 'NonCumulativeTemporality' WHEN ts_ns > {_NOW} + 600000000000 THEN 'FutureSkew' WHEN ts_ns < {_NOW} - 7200000000000 THEN 'TooOld' END AS rejected FROM e""",
    "ingest_summary": """WITH h AS (SELECT o_orderstatus AS status, min(o_totalprice) AS lo, max(o_totalprice) AS hi, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1)
SELECT name, status, quantile, round(CAST(value AS DOUBLE), 2) AS value, CAST(NULL AS VARCHAR) AS rejected FROM (SELECT 'total' AS name, status, '0.5' AS quantile, lo AS value FROM h UNION ALL SELECT 'total', status, '0.99', hi FROM h UNION ALL SELECT 'total_sum', status, '', s FROM h UNION ALL SELECT 'total_count', status, '', n FROM h) WHERE status <> 'P'
UNION ALL SELECT 'total', status, '', NULL, 'DuplicateQuantile' FROM h WHERE status = 'P'""",
    "ingest_exponential": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS name, p_partkey % 5 - 1 AS i0, p_size AS n, p_partkey % 7 = 0 AS bad FROM part)
SELECT name, CAST(i AS INTEGER) AS i, CAST(c AS DOUBLE) AS n, CASE WHEN bad THEN 'NativeHistogramCountMismatch' END AS rejected, CAST(n + 4 - CAST(bad AS INTEGER) AS DOUBLE) AS count, CAST(2 AS DOUBLE) AS neg1 FROM (SELECT *, i0 AS i, n AS c FROM p UNION ALL SELECT *, i0 + 1, 1 FROM p)""",
    "ingest_logs": f"""WITH e AS (SELECT *, epoch_us(ts) * 1000 AS t FROM events), r AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN {_NOW} ELSE t END AS ts_ns FROM e)
SELECT ts_ns, CASE WHEN event_id % 6 = 0 THEN 0 ELSE t END AS observed_ts_ns, CAST(CASE WHEN event_id % 300 <= 255 THEN event_id % 300 ELSE 0 END AS INTEGER) AS severity_num, '' AS severity_text, props AS body, CASE WHEN event_id % 2 = 0 THEN md5(CAST(event_id AS VARCHAR)) END AS trace_id, event_type AS kind, 'h' AS host,
CASE WHEN ts_ns > {_NOW} + 600000000000 THEN 'FutureSkew' WHEN ts_ns < {_NOW} - 7200000000000 THEN 'TooOld' END AS rejected FROM r""",
    "ingest_spans": """SELECT md5(CAST(l_orderkey AS VARCHAR)) AS trace_id, CASE WHEN l_linenumber <> 7 THEN substr(md5(l_orderkey || '-' || l_linenumber), 1, 16) END AS span_id, l_linestatus AS name, epoch_us(l_shipdate) * 1000 AS start_ns, CAST(CASE WHEN l_linenumber % 4 IN (1, 2) THEN l_linenumber % 4 ELSE 0 END AS INTEGER) AS status_code,
CASE l_linenumber % 7 WHEN 1 THEN 'internal' WHEN 2 THEN 'server' WHEN 3 THEN 'client' WHEN 4 THEN 'producer' WHEN 5 THEN 'consumer' END AS kind, '[]' AS events, l_returnflag AS host,
CASE WHEN l_linenumber = 7 THEN 'InvalidId' WHEN epoch_us(l_shipdate) * 1000 > 900000600000000000 THEN 'FutureSkew' WHEN epoch_us(l_shipdate) * 1000 + l_linenumber < 899992800000000000 THEN 'TooOld' END AS rejected FROM lineitem""",
    "exemplar_cap": f"WITH {_EVENTS} SELECT event_type, shard, max(t) AS ts_ns, arg_max(value, (t, event_id)) AS value, md5(CAST(arg_max(event_id, (t, event_id)) AS VARCHAR)) AS trace_id FROM e WHERE event_type = 'error' GROUP BY event_type, shard, t // 10000000000",
}


def queries() -> dict:
    """All queries by name."""
    made = (dedup_samples, erase_samples, retention_hours, retention_rows, compact_plan, analytics_summary, analytics_spikes, analytics_change_point, alert_active, alert_history, alert_latest, ingest_family, ingest_admission, ingest_histogram, ingest_points, ingest_summary, ingest_exponential, ingest_logs, ingest_spans, exemplar_cap)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """SQL by name."""
    return dict(ORACLE)
