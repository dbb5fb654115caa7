"""Alert records as a table, payloads, analytics entry, strict matching and decoded telemetry."""

import json

import pytest

from obsidia import alerting, errors, ingest
from obsidia.alerting.evaluate import RECORD, tick
from obsidia.engine import Engine
from obsidia.ingest import normalise
from obsidia.sources.series import SeriesSource
from obsidia.sql.names import rewritten

S = 10**9


def source(spark, rows):
    return SeriesSource({"m": lambda: spark.createDataFrame([(k, t * S, float(v), False) for k, t, v in rows], "labels map<string,string>, ts_ns long, value double, stale boolean")})


def test_a_repeated_key_is_an_error_even_where_nothing_meets_it(spark):
    e = Engine(spark, source(spark, [({"i": "1", "s": "a"}, 100, 1), ({"i": "2", "s": "b"}, 100, 2), ({"i": "2", "s": "c"}, 100, 3)]))
    with pytest.raises(Exception, match="AmbiguousMatch"):
        e.promql('m{i="1"} * on (i) m', 100 * S).collect()
    assert e.promql('m{i="1"} * on (i) m{i="1"}', 100 * S).count() == 1


def test_results_of_group_left_are_unique(spark):
    e = Engine(spark, source(spark, [({"i": "1", "s": "a"}, 100, 1), ({"i": "1", "s": "b"}, 100, 2), ({"i": "1", "s": "c"}, 100, 3)]))
    assert e.promql('m{s!="c"} * on (i) group_left m{s="c"}', 100 * S).count() == 2
    with pytest.raises(Exception, match="AmbiguousMatch"):
        e.promql('m{s!="c"} * on (i) group_left (s) m{s="c"}', 100 * S).collect()


def test_analytics_entry(spark):
    e = Engine(spark, source(spark, [({"i": str(i)}, t, i + t) for i in range(3) for t in range(10)]))
    assert e.analytics("m", 0, 100 * S).count() == 3
    with pytest.raises(errors.AnalyticsError, match="more than 2"):
        e.analytics("m", 0, 100 * S, most=2)
    with pytest.raises(errors.EmptySeries):
        e.analytics("m", 1000 * S, 2000 * S)


def test_alerts_on_alerts(spark):
    e = Engine(spark, source(spark, [({}, 0, 1)]), "/nowhere")
    records = spark.createDataFrame([("x", "r", 1, "firing", 1, 3, {})], RECORD)
    rule = alerting.Rule("meta", "select * from alerts where state = 'firing'", "sql")
    row = tick(e, rule, records, 10).first()
    assert row["state"] == "firing" and row["generation"] == 4
    with pytest.raises(errors.AlertingError):
        tick(e, rule, spark.createDataFrame([("x", "r", 1, "firing", 1, 8, {})], RECORD), 10)
    # a mention in quotes reads nothing
    assert tick(e, alerting.Rule("word", "select 'alerts' as a", "sql"), records, 10).first()["generation"] == 0


def test_history_by_alert(spark):
    rows = [("a", 0, True), ("a", 10, True), ("b", 0, False), ("b", 10, True), ("a", 20, False)]
    got = alerting.history(spark.createDataFrame(rows, "alert_id string, ts_ns long, active boolean"), 5).collect()
    assert sorted(map(tuple, got)) == [("a", 0, "pending"), ("a", 10, "firing"), ("a", 20, "resolved"), ("b", 10, "pending")]


def test_alertmanager_payload(spark):
    rows = [("x", "r", 2 * S, "resolved", S, 0, {"label.team": "a", "label.alertname": "no", "annotation.note": "n"}), ("y", "r", S, "pending", S, 0, {}), ("z", "r", S, "firing", S, 0, {})]
    got = {r["alert_id"]: json.loads(r["payload"])[0] for r in alerting.alertmanager(spark.createDataFrame(rows, RECORD), "http://e").collect()}
    assert got["x"] == {"labels": {"team": "a", "alertname": "r"}, "annotations": {"note": "n"}, "startsAt": "1970-01-01T00:00:01.000Z", "endsAt": "1970-01-01T00:00:02.000Z", "generatorURL": "http://e"}
    assert "endsAt" not in got["z"] and set(got) == {"x", "z"}


def test_points_reject_and_name(spark):
    kind = "name string, unit string, kind string, monotonic boolean, temporality int, resource map<string,string>, attrs map<string,struct<s:string,b:boolean,i:bigint,d:double,complex:boolean>>, ts_ns long, flags int, value double"
    now = 10**18
    text, yes, number, both = (("v", None, None, None, False), (None, True, None, None, False), (None, None, None, 2.0, False), (None, None, None, None, True))
    rows = [
        ("a.b", "By", "gauge", False, 0, {"service.name": "w"}, {"k": text, "t": yes, "d": number}, now, 0, 1.0), ("a", "", "sum", True, 1, {}, {}, now, 0, 1.0), ("a", "", "gauge", False, 0, {}, {"k": both}, now, 0, 1.0),
        ("", "", "gauge", False, 0, {}, {}, now, 0, 1.0), ("a", "", "summary", False, 0, {}, {}, now, 0, 1.0), ("a", "", "gauge", False, 0, {}, {}, 0, None, 1.0), ("a", "", "gauge", False, 0, {"service.name": "w"}, {"job": text}, now, 1, 1.0),
    ]
    got = normalise.points(spark.createDataFrame(rows, kind), now).collect()
    assert [r["rejected"] for r in got] == [None, "NonCumulativeTemporality", "ComplexAttributeValue", "EmptyMetricName", "UnsupportedKind", "ZeroTimestamp", None]
    assert got[0]["name"] == "a_b_bytes" and got[0]["labels"] == {"job": "w", "k": "v", "t": "true", "d": "2"}
    assert got[6]["stale"] and got[6]["value"] != got[6]["value"] and got[6]["labels"] == {"job": "v"}
    assert ingest.FUTURE_NS > 0


def test_rewritten_calls():
    assert rewritten("select 'concat(1)' , concat(a, concat(b, ')')) -- concat(x)\n from t") == "select 'concat(1)' , concat_ws('', a, concat_ws('', b, ')')) -- concat(x)\n from t"
    assert rewritten("select t.row, log(x), log(2, x) from t") == "select t.row, log10_ieee(x), (ln_ieee(x) / ln_ieee(2)) from t"
    with pytest.raises(errors.SqlParse):
        rewritten("select concat(a")
    with pytest.raises(errors.SqlParse):
        rewritten("select arrow_cast(a, 'Nothing')")


def test_long_tokens_are_cut(spark):
    from obsidia.sql.functions import register

    register(spark)
    row = spark.sql("select has_word(repeat('a', 70), repeat('a', 64)) a, has_word(repeat('a', 63), repeat('a', 64)) b, has_word(concat(repeat('é', 40), ' x'), concat(repeat('é', 32), ' x')) c, has_word('x', '') d").first()
    assert tuple(row) == (True, False, True, True)
