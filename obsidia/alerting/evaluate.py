"""One evaluation of a rule: latest record, query, transition, new record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.alerting import OPERATORS, Rule, latest, next_generation, transition
from obsidia.engine import Engine
from obsidia.sql.validate import validate

RECORD = "alert_id string, rule_id string, ts_ns long, state string, since_ns long, generation long, attrs map<string,string>"


def fires(engine: Engine, rule: Rule, now_ns: int, lookback: str = "5m", records: DataFrame | None = None) -> bool:
    """Whether any series meets the threshold, or the query has any row; ``records`` are the table ``alerts``."""
    if rule.kind == "sql":
        return engine.sql(rule.query, tables={} if records is None else {"alerts": records}).limit(1).count() > 0
    op, value = rule.threshold
    hit = engine.promql(rule.query, now_ns, lookback).where(F.expr(f"not isnan(value) and value {OPERATORS[op]} double('{value}')"))
    return hit.limit(1).count() > 0


def tick(engine: Engine, rule: Rule, records: DataFrame, now_ns: int, lookback: str = "5m", complete: bool = True) -> DataFrame:
    """The record to append, or none. A partial result leaves the alert as it is."""
    rule.check()
    spark = engine.spark
    none = spark.createDataFrame([], RECORD)
    if not complete:
        return none
    alert_id = rule.alert_id()
    last = latest(records.where(F.col("alert_id") == alert_id)).first()
    state, since = (last["state"], last["since_ns"]) if last else ("inactive", 0)
    state = "inactive" if state == "resolved" else state
    now_state, now_since, moved = transition(state, since, fires(engine, rule, now_ns, lookback, records), now_ns, rule.for_ns)
    if not moved:
        return none
    reads_alerts = rule.kind == "sql" and validate(rule.query) == "alerts"
    inputs = []
    if reads_alerts and last is None:
        # what the query may have read: the latest record of every other alert
        most = latest(records.where(F.col("alert_id") != alert_id)).agg(F.max("generation")).first()[0]
        inputs = [] if most is None else [most]
    generation = next_generation(last["generation"] if last else None, inputs, reads_alerts, rule.max_generation)
    attrs = {f"label.{k}": v for k, v in rule.labels.items()} | {f"annotation.{k}": v for k, v in rule.annotations.items()}
    return spark.createDataFrame([(alert_id, rule.rule_id, now_ns, now_state, now_since, generation, attrs)], RECORD)


def due(last_notified_ns: int | None, now_ns: int, state: str, repeat_ns: int) -> bool:
    """Whether a firing alert is to be notified again."""
    return state == "firing" and repeat_ns > 0 and (last_notified_ns is None or now_ns - last_notified_ns >= repeat_ns)
