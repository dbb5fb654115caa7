"""Analytics, alerting, ingest, maintenance and streaming."""

import numpy as np
import pytest

from obsidia import alerting, ingest, maintain, streaming
from obsidia.analytics import change_point
from obsidia.analytics.summary import summary
from obsidia.errors import AlertingError, InvalidPercentile, SeriesTooLong

S = 10**9


def series(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 240)
    if kind == "step_change":
        x[120:] += 8
    elif kind == "spike":
        x[150] += 40
    elif kind == "dip":
        x[90] -= 40
    elif kind == "trend_change":
        x[120:] += 0.5 * np.arange(120)
    elif kind == "distribution_change":
        x[120:] *= 8
    return x


@pytest.mark.parametrize(("kind", "at", "slack"), [("stationary", -1, 0), ("step_change", 120, 20), ("spike", 150, 10), ("dip", 90, 10), ("trend_change", 120, 25), ("distribution_change", 120, 25)])
def test_change_points(kind, at, slack):
    found, position, _ = change_point.detect(np.arange(240), series(kind))
    assert found == kind and abs(position - at) <= slack


def test_change_point_limits():
    assert change_point.detect(np.arange(10), np.arange(10.0))[0] == "indeterminable"
    assert change_point.detect(np.arange(50), np.full(50, 3.0))[0] == "stationary"
    with pytest.raises(SeriesTooLong):
        change_point.detect(np.arange(3000), np.zeros(3000), downsampled=False)
    ts, v = change_point.downsample(np.arange(4001), np.arange(4001.0))
    assert len(v) == 2000 and ts[0] == 0


def test_summary(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, 10.0, float("nan"))], "k string, value double")
    r = summary(df, ["k"], percentiles=(50, 100)).first()
    assert (r["n"], r["nan_excluded"], r["median"], r["mad"], r["p100"]) == (4, 1, 2.5, 1.0, 10.0)
    with pytest.raises(InvalidPercentile):
        summary(df, ["k"], percentiles=(101,))


def test_rules():
    alerting.Rule("r", "up", threshold=("Gt", 1.0)).check()
    for bad in (alerting.Rule("", "up", threshold=("Gt", 1.0)), alerting.Rule("r", "up"), alerting.Rule("r", "select 1", kind="sql", threshold=("Gt", 1.0)), alerting.Rule("r", "up", threshold=("Like", 1.0))):
        with pytest.raises(AlertingError):
            bad.check()
    a, b = alerting.Rule("r", "q", labels={"x": "1", "y": "2"}), alerting.Rule("r", "other", labels={"y": "2", "x": "1"})
    assert a.alert_id() == b.alert_id()
    assert alerting.next_generation(None, [2, 5], True) == 6 and alerting.next_generation(3, [], True) == 3 and alerting.next_generation(None, [4], False) == 0
    with pytest.raises(AlertingError):
        alerting.next_generation(None, [8], True)


def test_transitions_agree_with_history(spark):
    rng = np.random.default_rng(1)
    active = [bool(x) for x in rng.integers(0, 2, 60)]
    steps = spark.createDataFrame([(i * 10, a) for i, a in enumerate(active)], "ts_ns long, active boolean")
    got = [(r["ts_ns"], r["state"]) for r in alerting.history(steps, 20).orderBy("ts_ns").collect()]
    state, since, want = "inactive", 0, []
    for i, a in enumerate(active):
        state, since, moved = alerting.transition(state, since, a, i * 10, 20)
        if moved:
            want.append((i * 10, state))
        state = "inactive" if state == "resolved" else state
    assert got == want
    assert alerting.transition("suppressed", 0, True, 5, 0) == ("suppressed", 0, False)


def test_families(spark):
    rows = [("http.requests", "1", "sum", True), ("mem", "By", "gauge", False), ("mem_bytes", "By", "gauge", False), ("io", "By/s", "gauge", False), ("load", "1", "gauge", False), ("ops_total", "{op}", "sum", True), ("9lives", "", "gauge", False)]
    df = spark.createDataFrame(rows, "n string, u string, k string, m boolean").select(ingest.family(*[__import__("pyspark.sql.functions", fromlist=["col"]).col(c) for c in "nukm"]).alias("f"))
    assert [r["f"] for r in df.collect()] == ["http_requests_total", "mem_bytes", "mem_bytes", "io_bytes_per_second", "load_ratio", "ops_total", "_lives"]


def test_admission_and_histograms(spark):
    now = 10**18
    df = spark.createDataFrame([(0,), (now,), (now + ingest.FUTURE_NS + 1,), (now - ingest.PAST_NS - 1,), (now - ingest.PAST_NS,)], "ts_ns long")
    assert [r["rejected"] for r in ingest.admitted(df, now).collect()] == ["ZeroTimestamp", None, "FutureSkew", "TooOld", None]
    h = spark.createDataFrame([("h", {"a": "b"}, 1, [0.5, 2.0], [1, 2, 3], 9.0), ("bad", {}, 1, [2.0, 1.0], [1, 1, 1], 1.0), ("short", {}, 1, [1.0], [1], 1.0)], "name string, labels map<string,string>, ts_ns long, bounds array<double>, counts array<long>, sum double")
    got = sorted((r["name"], r["labels"].get("le", ""), r["value"]) for r in ingest.explode_histogram(h).collect())
    assert got == [("h_bucket", "+Inf", 6.0), ("h_bucket", "0.5", 1.0), ("h_bucket", "2", 3.0), ("h_count", "", 6.0), ("h_sum", "", 9.0)]


def test_maintenance(spark, tmp_path):
    rows = [({"a": "x"}, i * 1800 * S, float(i)) for i in range(10)] + [({"a": "y"}, i * 1800 * S, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "labels map<string,string>, ts_ns long, value double")
    assert maintain.erase(df, [maintain.Erasure({"a": "x"}, 1800 * S, 3 * 1800 * S)]).count() == 18
    assert maintain.erase(df, [maintain.Erasure({"a": "x"})]).count() == 10
    assert maintain.retain(df, 5 * 3600 * S, 2 * 3600 * S).count() == 8
    assert maintain.retain(df, 5 * 3600 * S, 2 * 3600 * S, held=[0]).count() == 12
    src = str(tmp_path / "in")
    df.repartition(4).write.parquet(src)
    assert maintain.compact(spark.read.parquet(src), str(tmp_path / "out"), ["ts_ns"]) == 20
    assert len([f for f in (tmp_path / "out").iterdir() if f.suffix == ".parquet"]) == 1


def test_streams(spark, tmp_path):
    rows = [("k1", "2024-01-01 00:00:00", 1.0), ("k1", "2024-01-01 00:00:00", 1.0), ("k2", "2024-01-01 01:00:00", 2.0), ("k3", "2024-01-01 00:30:00", 4.0)]
    df = spark.createDataFrame(rows, "id string, t string, value double").selectExpr("id", "cast(t as timestamp) ts", "value", "'m' as name")
    df.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    q = streaming.deduplicated(stream, ["id"]).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable(), q.stop()
    assert spark.table("once").count() == 3
    q = streaming.hopping(stream, ["name"], "1 hour", "1 hour").writeStream.format("memory").queryName("hops").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable(), q.stop()
    # a sample on the edge belongs to the window that ends there
    assert {(str(r["end"]), r["n"]) for r in spark.table("hops").collect()} == {("2024-01-01 00:00:00", 2), ("2024-01-01 01:00:00", 2)}


def test_streaming_alert_states(spark, tmp_path):
    df = spark.createDataFrame([("a", i * 10, x) for i, x in enumerate([True, True, True, False])], "alert_id string, ts_ns long, active boolean").coalesce(1)
    df.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    q = alerting.stream_states(stream, 20).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable(), q.stop()
    assert [(r["ts_ns"], r["state"]) for r in spark.table("states").orderBy("ts_ns").collect()] == [(0, "pending"), (20, "firing"), (30, "resolved")]
