"""PromQL over small made-up series with hand-computed results."""

import math

import pytest

from obsidia.engine import Engine
from obsidia.errors import EvalBudgetExhausted, InvalidLabelName, NonPositiveStep, Parse, TooManyPoints, Unsupported, WrongType
from obsidia.sources.series import SeriesSource, deduplicated

S = 10**9
BASE = 1_700_000_000 * S


def series(spark, rows):
    """rows: (labels, [(seconds, value or None for a marker)])."""
    flat = [(labels, BASE + t * S, math.nan if v is None else float(v), v is None) for labels, points in rows for t, v in points]
    return spark.createDataFrame(flat, "labels map<string,string>, ts_ns long, value double, stale boolean")


@pytest.fixture(scope="module")
def engine(spark):
    data = {
        "g": [({"job": "a", "i": "1"}, [(0, 10), (30, 20), (60, 15)]), ({"job": "a", "i": "2"}, [(0, 20), (60, 25)]), ({"job": "b", "i": "1"}, [(0, 5), (60, 7)])],
        "c": [({"s": "reset"}, [(0, 0), (30, 10), (60, 20), (90, 5), (120, 15)])],
        "stale": [({}, [(0, 5), (30, None), (60, 6)])],
        "odd": [({"k": "nan"}, [(0, math.nan)]), ({"k": "zero"}, [(0, -0.0)]), ({"k": "one"}, [(0, 1)]), ({"k": "inf"}, [(0, math.inf)])],
        "meta": [({"job": "a", "version": "v1"}, [(60, 1)]), ({"job": "b", "version": "v2"}, [(60, 1)])],
        "dup": [({"job": "a", "r": "1"}, [(60, 1)]), ({"job": "a", "r": "2"}, [(60, 1)])],
        "h_bucket": [({"le": le}, [(60, v)]) for le, v in (("0.1", 1), ("0.5", 3), ("1", 6), ("+Inf", 10))],
    }
    return Engine(spark, SeriesSource({n: (lambda rows=rows: series(spark, rows)) for n, rows in data.items()}))


def at(engine, query, seconds=60):
    return {r["labels"]: r["value"] for r in engine.promql(query, BASE + seconds * S).collect()}


def test_lookback_is_left_open(engine):
    assert at(engine, 'g{job="b"}', 0) == {'{"__name__":"g","i":"1","job":"b"}': 5.0}
    assert at(engine, 'g{job="b"}', 359)
    assert at(engine, 'g{job="b"}', 360) == {}


def test_staleness(engine):
    assert at(engine, "stale", 29) and at(engine, "stale", 30) == {} and at(engine, "stale", 60)
    assert at(engine, "count_over_time(stale[2m])", 60) == {"{}": 2.0}


def test_counter_functions(engine):
    sig = '{"s":"reset"}'
    assert at(engine, "resets(c[3m])", 120) == {sig: 1.0}
    assert at(engine, "changes(c[3m])", 120) == {sig: 4.0}
    assert at(engine, "irate(c[3m])", 90) == {sig: 5 / 30}
    assert at(engine, "idelta(c[3m])", 90) == {sig: -15.0}
    assert at(engine, "increase(c[2m])", 120)[sig] == pytest.approx(25 / 90 * 120)
    # the counter's zero bounds the extrapolation to the left
    assert at(engine, "increase(c[10m])", 120)[sig] == pytest.approx(35.0)
    assert at(engine, "rate(c[30s])", 30) == {}


def test_specials(engine):
    assert at(engine, "min(odd)", 0) == {"{}": 0.0}
    assert at(engine, "max(odd)", 0) == {"{}": math.inf}
    assert math.isnan(at(engine, "sum(odd)", 0)["{}"])
    assert at(engine, "odd > 0", 0).keys() == {'{"__name__":"odd","k":"one"}', '{"__name__":"odd","k":"inf"}'}
    assert at(engine, "ln(odd)", 0)['{"k":"zero"}'] == -math.inf
    assert at(engine, '1 / odd{k="one"}', 0) == {'{"k":"one"}': 1.0}
    assert math.isnan(at(engine, 'odd{k="zero"} / 0', 0)['{"k":"zero"}'])
    assert list(at(engine, "topk(4, odd)", 0).values())[-1] is not None
    assert at(engine, "quantile(2, odd)", 0) == {"{}": math.inf}
    assert set(at(engine, 'count_values("v", odd)', 0)) == {'{"v":"NaN"}', '{"v":"-0"}', '{"v":"1"}', '{"v":"+Inf"}'}


def test_aggregations(engine):
    assert at(engine, "sum by (job) (g)") == {'{"job":"a"}': 40.0, '{"job":"b"}': 7.0}
    assert at(engine, "avg without (i) (g)") == {'{"job":"a"}': 20.0, '{"job":"b"}': 7.0}
    assert at(engine, "quantile(0.5, g)") == {"{}": 15.0}
    assert set(at(engine, "topk(2, g)").values()) == {25.0, 15.0}
    assert at(engine, "topk(0, g)") == {}


def test_matching(engine):
    assert at(engine, "g * on (job) group_left (version) meta") == {'{"i":"1","job":"a","version":"v1"}': 15.0, '{"i":"2","job":"a","version":"v1"}': 25.0, '{"i":"1","job":"b","version":"v2"}': 7.0}
    with pytest.raises(Exception, match="AmbiguousMatch"):
        at(engine, "g * on (job) group_left dup")
    with pytest.raises(Exception, match="AmbiguousMatch"):
        at(engine, "g * on (job) meta")
    assert set(at(engine, "g unless on (job) dup")) == {'{"__name__":"g","i":"1","job":"b"}'}


def test_histogram(engine):
    assert at(engine, "histogram_quantile(0.5, h_bucket)")["{}"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert at(engine, "histogram_quantile(0.99, h_bucket)") == {"{}": 1.0}
    assert at(engine, "histogram_quantile(-1, h_bucket)") == {"{}": -math.inf}
    assert at(engine, "histogram_fraction(0.1, 0.5, h_bucket)")["{}"] == pytest.approx(0.2)


def test_range_grid_and_subquery(engine):
    rows = engine.promql_range('g{job="a",i="1"}', BASE, BASE + 60 * S, 30 * S).orderBy("ts_ns").collect()
    assert [r["value"] for r in rows] == [10.0, 20.0, 15.0]
    assert at(engine, 'max_over_time(g{job="a",i="1"}[1m:10s])') == {'{"i":"1","job":"a"}': 20.0}
    assert at(engine, 'g{job="a",i="1"} @ 1700000030') == {'{"__name__":"g","i":"1","job":"a"}': 20.0}
    assert at(engine, 'g{job="a",i="1"} offset 30s') == {'{"__name__":"g","i":"1","job":"a"}': 20.0}


def test_scalars_and_labels(engine):
    assert at(engine, "scalar(g)")["{}"] != at(engine, "scalar(g)")["{}"]
    assert at(engine, 'scalar(g{job="b"}) + 1') == {"{}": 8.0}
    assert at(engine, 'label_replace(g{job="b"}, "i", "", "i", ".*")') == {'{"__name__":"g","job":"b"}': 7.0}
    assert at(engine, 'absent(g{job="z",i="3"})') == {'{"i":"3","job":"z"}': 1.0}
    assert at(engine, "round(-2.5 + vector(0))") == {"{}": -2.0}


@pytest.mark.parametrize(("query", "error"), [("g[5m]", None), ("rate(g)", WrongType), ("1 > 2", Parse), ("g and 1", WrongType), ("histogram_stddev(g)", Unsupported), ('label_join(g, "1x", "-", "job")', InvalidLabelName), ("max_over_time(g[30d:1s])", EvalBudgetExhausted)])
def test_types(engine, query, error):
    if error is None:
        assert engine.promql(query, BASE + 60 * S).count() == 7
    else:
        with pytest.raises(error):
            engine.promql(query, BASE)


def test_grid_limits(engine):
    with pytest.raises(NonPositiveStep):
        engine.promql_range("g", BASE, BASE, 0)
    with pytest.raises(TooManyPoints):
        engine.promql_range("g", BASE, BASE + 20_000 * S, S)


def test_deduplication(spark):
    rows = [("a", 1, 1.0, 5, 0), ("a", 1, 2.0, 6, 0), ("a", 1, 3.0, 6, 1), ("b", 1, 9.0, 1, 0)]
    df = spark.createDataFrame(rows, "series_id string, ts_ns long, value double, created long, seq long")
    got = {r["series_id"]: r["value"] for r in deduplicated(df, ["series_id", "ts_ns"], ["created", "seq"], "value").collect()}
    assert got == {"a": 3.0, "b": 9.0}
