"""Loading, typed attributes, result formats and single evaluations."""

import json
import math

import pytest

from obsidia.alerting import Rule
from obsidia.alerting import evaluate as alerts
from obsidia.engine import Engine
from obsidia.errors import Parse
from obsidia.sources import formats
from obsidia.sources.series import SeriesSource

S = 10**9


def test_bulk_load_and_declared(spark, tmp_path):
    rows = [(1_000_000, "a", 5, "x"), (None, "b", 6, "y"), (10**16, "c", 7, "z")]
    spark.createDataFrame(rows, "t long, msg string, n long, s string").write.parquet(str(tmp_path / "in"))
    good, bad = formats.bulk_load(spark, str(tmp_path / "in"), formats.Mapping("t", "us", "msg", {"n": "i64", "s": "str"}), now_ns=10**12)
    r = formats.declared(good, {"n": "i64", "s": "i64", "none": "str"}).first()
    assert (r["ts_ns"], r["body"], r["n"], r["s"], r["none"]) == (10**9, "a", 5, None, None)
    assert sorted(x["reason"] for x in bad.collect()) == ["FutureSkew", "NoTimestamp"]


def test_attributes_of_the_record_win(spark):
    df = spark.createDataFrame([({"a": "1", "b": "1"}, {"b": "2"}, None), ({"a": "1"}, {"a": "2"}, {"a": "3"})], "r map<string,string>, s map<string,string>, o map<string,string>")
    assert [x[0] for x in df.select(formats.merged_attrs(df.r, df.s, df.o)).collect()] == [{"a": "1", "b": "2"}, {"a": "3"}]


def test_json_rows(spark):
    df = spark.createDataFrame([(1, math.nan, bytearray(b"\xab"), {"k": 'v"'}), (None, -math.inf, None, None), (2, 1.5, bytearray(b""), {})], "i int, d double, b binary, m map<string,string>")
    got = [json.loads(r["json"]) for r in formats.json_rows(df).collect()]
    assert got == [{"i": 1, "d": "NaN", "b": "ab", "m": {"k": 'v"'}}, {"i": None, "d": "-Inf", "b": None, "m": None}, {"i": 2, "d": 1.5, "b": "", "m": {}}]


def test_envelope(spark):
    df = spark.createDataFrame([('{"a":"1"}', 2 * S, 1.0), ('{"a":"1"}', S, math.inf)], "labels string, ts_ns long, value double")
    assert formats.envelope(df, "matrix")["data"]["result"] == [{"metric": {"a": "1"}, "values": [[1.0, "+Inf"], [2.0, "1"]]}]
    assert formats.number_text(0.25) == "0.25"


def test_parameters():
    assert formats.time_ns("1970-01-01T00:00:01.5Z") == 1_500_000_000 == formats.time_ns("1.5")
    assert formats.time_ns("1970-01-01T01:00:00+01:00") == 0
    assert formats.step_ns("5m") == 300 * S
    with pytest.raises(Parse):
        formats.time_ns("soon")


def test_ticks(spark):
    values = [(0, 1.0), (60, 9.0), (120, 9.0), (180, 1.0)]
    frame = lambda: spark.createDataFrame([({}, t * S, v, False) for t, v in values], "labels map<string,string>, ts_ns long, value double, stale boolean")
    engine = Engine(spark, SeriesSource({"m": frame}))
    rule = Rule("hot", "m", threshold=("Gt", 5.0), for_ns=60 * S, labels={"team": "x"})
    records, states = spark.createDataFrame([], alerts.RECORD), []
    for t, _ in values:
        new = spark.createDataFrame(alerts.tick(engine, rule, records, t * S).collect(), alerts.RECORD)
        states += [r["state"] for r in new.collect()]
        records = records.unionByName(new)
    assert states == ["pending", "firing", "resolved"]
    assert alerts.tick(engine, rule, records, 60 * S, complete=False).count() == 0
    assert alerts.due(None, 0, "firing", 60 * S) and not alerts.due(0, 30 * S, "firing", 60 * S) and not alerts.due(None, 0, "firing", 0)
