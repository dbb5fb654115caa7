"""Native histograms by hand-computed results."""

import math

import pytest

from obsidia.engine import Engine
from obsidia.errors import Unsupported
from obsidia.operators import native
from obsidia.sources.series import SeriesSource

S = 10**9
BASE = 1_700_000_000 * S


def hist(counts, scale=0, first=1, zero=0.0, total=None, sum_=0.0, neg=None, hint="unknown"):
    pos = {first + i: float(c) for i, c in enumerate(counts)}
    return {"scale": scale, "zero_threshold": 0.001, "zero_count": zero, "count": float(sum(counts) + zero + sum((neg or {}).values())), "sum": sum_, "pos": pos, "neg": neg or {}, "custom": [], "hint": hint}


@pytest.fixture(scope="module")
def engine(spark):
    rows = [({"i": "1"}, BASE + t * S, hist([a, b], sum_=s), False) for t, a, b, s in ((0, 1, 1, 3.0), (30, 2, 3, 9.0), (60, 4, 4, 15.0))]
    rows += [({"i": "2"}, BASE + 60 * S, hist([2, 2, 4, 8], scale=1, first=1, sum_=5.0), False)]
    make = lambda: spark.createDataFrame(rows, f"labels map<string,string>, ts_ns long, hist {native.TYPE}, stale boolean")
    flat = lambda: spark.createDataFrame([({}, BASE + 60 * S, 1.0, False)], "labels map<string,string>, ts_ns long, value double, stale boolean")
    return Engine(spark, SeriesSource({"flat": flat}, {"h": make}))


def at(engine, query, seconds=60):
    return {r["labels"]: r["value"] for r in engine.promql(query, BASE + seconds * S).collect()}


def test_fields(engine):
    assert at(engine, "histogram_count(h)") == {'{"i":"1"}': 8.0, '{"i":"2"}': 16.0}
    assert at(engine, 'histogram_sum(h{i="1"})') == {'{"i":"1"}': 15.0}
    assert at(engine, 'histogram_avg(h{i="1"})') == {'{"i":"1"}': 15 / 8}
    assert at(engine, "histogram_count(flat)") == {}


def test_quantile_and_fraction(engine):
    assert at(engine, 'histogram_quantile(0.5, h{i="1"})')['{"i":"1"}'] == pytest.approx(2.0)
    assert at(engine, 'histogram_quantile(0.75, h{i="1"})')['{"i":"1"}'] == pytest.approx(2 * 2**0.5)
    assert at(engine, 'histogram_fraction(1, 2, h{i="1"})')['{"i":"1"}'] == pytest.approx(0.5)
    assert native.quantile(2, hist([1])) == math.inf and math.isnan(native.quantile(0.5, hist([0])))
    assert native.quantile(0.25, hist([1], zero=3.0)) == pytest.approx(0.001 / 3)


def test_increase_and_reset(engine):
    # two equal steps of 30 s in a minute's window: the left edge is open, so one sample is outside
    assert at(engine, 'histogram_count(increase(h{i="1"}[1m]))')['{"i":"1"}'] == pytest.approx(3 * 2)
    assert at(engine, 'histogram_count(rate(h{i="1"}[1m]))')['{"i":"1"}'] == pytest.approx(0.1)
    down = [hist([5]), hist([2]), hist([3])]
    out = native.reduce_window([0, 30 * S, 60 * S], down, 60 * S, 60 * S, True, False)
    assert out["count"] == pytest.approx(3.0)
    assert native.reduce_window([0], down[:1], 0, 60 * S, True, False) is None


def test_sum_aligns_scales(engine):
    got = engine.promql("sum(h)", BASE + 60 * S).first()["hist"]
    assert got["scale"] == 0 and got["count"] == 24.0 and got["pos"] == {1: 8.0, 2: 16.0}
    assert engine.promql("avg(h)", BASE + 60 * S).first()["hist"]["count"] == 12.0
    assert at(engine, "count(h)") == {"{}": 2.0}


def test_rejected(engine):
    with pytest.raises(Unsupported):
        at(engine, "max_over_time(h[5m])")
    with pytest.raises(Unsupported):
        at(engine, "rate(h[1m:10s])")
