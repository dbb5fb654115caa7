"""Plans keep what scale depends on."""

import os

import pytest

from obsidia.engine import Engine
from obsidia.queries import promql as P

SF = "/root/testdata/sf0.001"


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.fixture(scope="module")
def engine(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return Engine.open(spark, SF)


def test_bounds_and_matchers_reach_the_scan(engine):
    text = plan(engine.promql_range('avg_over_time(event_value{event_type="error"}[12h])', P.START, P.END, P.STEP))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text and "EqualTo(event_type,error)" in text
    assert "props" not in next(line for line in text.splitlines() if "ReadSchema" in line)


def test_windows_are_no_range_join(engine):
    text = plan(engine.promql_range("sum by (event_type) (rate(events_value_total[12h]))", P.START, P.END, P.STEP))
    assert "Join" not in text and "Python" not in text and "HashAggregate" in text


def test_deduplication_is_one_aggregation(spark, engine):
    from obsidia.queries.misc import dedup_samples

    text = plan(dedup_samples(spark, SF))
    tree = text[: text.index("(1) Scan")]
    assert tree.count("Exchange") == 1 and "Window" not in tree
