"""Bulk loading by a mapping, typed attributes, result formats and parameter syntax."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsidia.errors import Parse
from obsidia.plans.parser import duration_ns

_SCALE = {"s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}
ATTR = "struct<t:string,s:string,i:bigint,d:double,b:boolean>"
_FIELD = {"str": "s", "i64": "i", "f64": "d", "bool": "b"}


@dataclass
class Mapping:
    """How a flat Parquet table becomes log records: its time column and unit, body, and attributes by kind."""

    ts: str
    unit: str = "us"
    body: str | None = None
    attrs: dict[str, str] = field(default_factory=dict)


def bulk_load(spark: SparkSession, path: str, mapping: Mapping, now_ns: int, most_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Admitted records (``ts_ns, body, attrs``) and rejected ones with their ``reason``; both are lazy."""
    df = spark.read.parquet(path)
    kind = dict(df.dtypes)[mapping.ts]
    if kind.startswith("timestamp"):
        raw, scale = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{mapping.ts}` as timestamp_ntz))"), 1000
    else:
        raw, scale = F.col(mapping.ts).cast("bigint"), _SCALE[mapping.unit]
    ts = F.try_multiply(raw, F.lit(scale).cast("bigint"))
    ts = F.when(ts.isNull() & (raw > 0), F.lit(2**63 - 1)).otherwise(ts)  # beyond the range of nanoseconds
    attrs = [x for name, t in mapping.attrs.items() for x in (F.lit(name), typed(F.col(name), t))]
    body = F.col(mapping.body).cast("string") if mapping.body else F.lit("")
    rows = df.select(ts.alias("ts_ns"), body.alias("body"), (F.create_map(*attrs) if attrs else F.expr("map()")).cast(f"map<string,{ATTR}>").alias("attrs"))
    reason = F.when(F.col("ts_ns").isNull(), "NoTimestamp").when(F.col("ts_ns") > now_ns + 600 * 10**9, "FutureSkew").when(F.octet_length("body") > most_bytes, "TooLarge")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def typed(value: Column, kind: str) -> Column:
    """One attribute value with its type."""
    parts = [F.lit(kind).alias("t")]
    for k, name in _FIELD.items():
        cast = {"s": "string", "i": "bigint", "d": "double", "b": "boolean"}[name]
        parts.append((value.cast(cast) if k == kind else F.lit(None).cast(cast)).alias(name))
    return F.when(value.isNotNull(), F.struct(*parts))


def declared(df: DataFrame, columns: dict[str, str], attrs: str = "attrs") -> DataFrame:
    """Adds declared attributes as columns; a value of another type reads null and is never cast."""
    return df.withColumns({name: F.when(F.col(attrs)[name]["t"] == kind, F.col(attrs)[name][_FIELD[kind]]) for name, kind in columns.items()})


def merged_attrs(resource: Column, scope: Column, record: Column) -> Column:
    """Attributes of a record over its scope's over its resource's."""
    none = F.expr("cast(map() as map<string,string>)")
    r, s, own = (F.coalesce(x, none) for x in (resource, scope, record))
    under = F.map_concat(F.map_filter(r, lambda k, v: ~F.map_contains_key(s, k)), s)
    return F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(own, k)), own)


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row: NaN and infinities as strings, binary as hex."""

    def shown(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            odd = F.when(F.isnan(c), "NaN").when(c == math.inf, "+Inf").when(c == -math.inf, "-Inf")
            return F.when(odd.isNotNull(), F.concat(F.lit('"'), odd, F.lit('"'))).otherwise(F.coalesce(c.cast("string"), F.lit("null")))
        value = F.lower(F.hex(c)) if kind == "binary" else c
        whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
        return F.regexp_extract(whole, r'(?s)^\{"v":(.*)\}$', 1)

    parts = []
    for i, (name, kind) in enumerate(df.dtypes):
        parts += [F.lit(("," if i else "{") + json.dumps(name) + ":"), shown(name, kind)]
    return df.select(F.concat(*parts, F.lit("}")).alias("json"))


def number_text(x: float) -> str:
    """A sample value as the query API writes it."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def envelope(df: DataFrame, kind: str) -> dict:
    """The query API's document of a finished result (``vector``, ``matrix`` or ``scalar``)."""
    rows = df.orderBy("labels", "ts_ns").collect()
    point = lambda r: [r["ts_ns"] / 1e9, number_text(r["value"])]
    if kind == "scalar":
        result = point(rows[0])
    elif kind == "vector":
        result = [{"metric": json.loads(r["labels"]), "value": point(r)} for r in rows]
    else:
        series: dict[str, list] = {}
        for r in rows:
            series.setdefault(r["labels"], []).append(point(r))
        result = [{"metric": json.loads(k), "values": v} for k, v in series.items()]
    return {"status": "success", "data": {"resultType": kind, "result": result}}


def time_ns(text: str) -> int:
    """Nanoseconds of an RFC 3339 time or of float seconds."""
    try:
        return round(float(text) * 10**9)
    except ValueError:
        pass
    try:
        when = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise Parse(f"not a time: {text}") from None
    when = when if when.tzinfo else when.replace(tzinfo=timezone.utc)
    return round((when - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 10**6) * 1000


def step_ns(text: str) -> int:
    """Nanoseconds of a step: a duration or bare seconds."""
    return duration_ns(text)
