"""Alert rules, their evaluation and the state machine of their transitions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsidia.errors import AlertingError

OPERATORS = {"Gt": ">", "Ge": ">=", "Lt": "<", "Le": "<=", "Eq": "=", "Ne": "<>"}
MAX_GENERATION = 8


@dataclass
class Rule:
    """``kind`` promql needs a threshold ``(operator, value)``; sql fires on any row."""

    rule_id: str
    query: str
    kind: str = "promql"
    threshold: tuple[str, float] | None = None
    labels: dict[str, str] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)
    for_ns: int = 0
    repeat_ns: int = 60 * 10**9
    max_generation: int = MAX_GENERATION

    def check(self) -> None:
        """Raise if the rule is malformed."""
        if not self.rule_id or not self.query.strip():
            raise AlertingError("a rule needs an id and a query")
        if self.kind not in ("promql", "sql"):
            raise AlertingError(f"unknown kind {self.kind}")
        if (self.kind == "promql") != (self.threshold is not None):
            raise AlertingError("promql rules have a threshold, sql rules fire on any row")
        if self.threshold and self.threshold[0] not in OPERATORS:
            raise AlertingError(f"unknown operator {self.threshold[0]}")

    def alert_id(self) -> str:
        """Identity: the rule and its sorted labels."""
        text = self.rule_id + "".join(f"\0{k}\0{v}" for k, v in sorted(self.labels.items()))
        return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def next_generation(prior: int | None, inputs: list[int], reads_alerts: bool, most: int = MAX_GENERATION) -> int:
    """Generation of a new record: kept if there is one, else one above what the query read."""
    if prior is not None:
        return prior
    out = max(inputs, default=0) + 1 if reads_alerts else 0
    if out > most:
        raise AlertingError(f"generation {out} is beyond {most}")
    return out


def transition(state: str, since: int, active: bool, now: int, for_ns: int) -> tuple[str, int, bool]:
    """New state, since when, and whether it is a transition; suppressed alerts stay until they go inactive."""
    if not active:
        return ("resolved", now, True) if state in ("firing", "suppressed") else ("inactive", now, state == "pending")
    if state in ("firing", "suppressed"):
        return state, since, False
    if state == "pending":
        return ("firing", now, True) if now - since >= for_ns else (state, since, False)
    return ("firing", now, True) if for_ns == 0 else ("pending", now, True)


def active_steps(df: DataFrame, rule: Rule) -> DataFrame:
    """``ts_ns, active`` per evaluation time: whether any series meets the threshold."""
    op, value = rule.threshold
    return df.groupBy("ts_ns").agg(F.max(F.expr(f"not isnan(value) and value {OPERATORS[op]} double('{value}')")).alias("active"))


def history(steps: DataFrame, for_ns: int) -> DataFrame:
    """Transitions ``ts_ns, state`` of evaluations, by window functions alone; by ``alert_id`` where there is one.

    A run of active steps is pending from its first and firing from the first that is ``for_ns`` later; the first
    inactive step after it resolves it, or drops it if it never fired.
    """
    key = [c for c in steps.columns if c == "alert_id"]
    by = Window.partitionBy(*key).orderBy("ts_ns")
    runs = steps.withColumn("change", (F.coalesce(F.lag("active").over(by), F.lit(False)) != F.col("active")).cast("int")).withColumn("run", F.sum("change").over(by))
    inside = runs.withColumn("since", F.min("ts_ns").over(Window.partitionBy(*key, "run")))
    fires = F.col("active") & (F.col("ts_ns") - F.col("since") >= for_ns)
    stated = inside.withColumn("state", F.when(fires, "firing").when(F.col("active"), "pending").otherwise("inactive"))
    before = stated.withColumn("prior", F.coalesce(F.lag("state").over(by), F.lit("inactive")))
    state = F.when((F.col("state") == "inactive") & (F.col("prior") == "firing"), "resolved").otherwise(F.col("state"))
    return before.where(F.col("state") != F.col("prior")).select(*key, "ts_ns", state.alias("state"))


def latest(records: DataFrame) -> DataFrame:
    """Last record of each alert."""
    return records.groupBy("alert_id").agg(F.max_by(F.struct(*[c for c in records.columns if c != "alert_id"]), "ts_ns").alias("x")).select("alert_id", "x.*")


def webhook(records: DataFrame) -> DataFrame:
    """One JSON payload per record."""
    return records.select("alert_id", F.to_json(F.struct(*records.columns)).alias("payload"))


def alertmanager(records: DataFrame, generator_url: str = "") -> DataFrame:
    """``alert_id, payload``: each firing or resolved record as an alert of the Alertmanager v2 API.

    Labels and annotations come from ``attrs`` (``label.`` and ``annotation.``); the rule's id is the ``alertname``.
    A firing alert has no end.
    """
    named = lambda prefix: F.transform_keys(F.map_filter("attrs", lambda k, v: k.startswith(prefix)), lambda k, v: F.substring(k, len(prefix) + 1, 512))
    labels = F.map_concat(F.map_filter(named("label."), lambda k, v: k != "alertname"), F.create_map(F.lit("alertname"), F.col("rule_id")))
    time = lambda ns: F.date_format(F.timestamp_micros(F.expr(f"{ns} div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    alert = F.struct(labels.alias("labels"), named("annotation.").alias("annotations"), time("since_ns").alias("startsAt"), F.when(F.col("state") == "resolved", time("ts_ns")).alias("endsAt"), F.lit(generator_url).alias("generatorURL"))
    return records.where("state in ('firing', 'resolved')").select("alert_id", F.to_json(F.array(alert)).alias("payload"))


def stream_states(steps: DataFrame, for_ns: int) -> DataFrame:
    """Streaming state machine over ``alert_id, ts_ns, active``: ``alert_id, ts_ns, state`` at each transition."""

    def run(key, batches, state):
        name, since = state.get if state.exists else ("inactive", 0)
        rows = pd.concat(list(batches)).sort_values("ts_ns")
        out = []
        for ts, active in zip(rows["ts_ns"], rows["active"]):
            name, since, moved = transition(name, since, bool(active), int(ts), for_ns)
            if moved:
                out.append((key[0], int(ts), name))
        state.update((name, since))
        yield pd.DataFrame(out, columns=["alert_id", "ts_ns", "state"])

    return steps.groupBy("alert_id").applyInPandasWithState(run, "alert_id string, ts_ns long, state string", "state string, since long", "append", "NoTimeout")
