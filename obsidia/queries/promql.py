"""PromQL queries over the event metrics, each beside SQL that computes it another way: by range joins in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsidia.engine import Engine

H = 3600 * 10**9
START = 1_704_153_600 * 10**9  # 2024-01-02
END = START + 6 * 24 * H
STEP = 6 * H
AT = START + 5 * 24 * H
LOOKBACK = "6h"

_JSON = """'{"event_type":"' || event_type || '","shard":"' || shard || '"}'"""
_NAMED = """'{"__name__":"%s","event_type":"' || event_type || '","shard":"' || shard || '"}'"""
_EVENTS = "e AS (SELECT event_id, event_type, CAST(user_id % 4 AS VARCHAR) AS shard, epoch_us(ts) * 1000 AS t, value FROM events)"
_METRIC = {
    "event_value": "SELECT event_type, shard, t, value AS v FROM e",
    "events_value_total": "SELECT event_type, shard, t, (CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_type, shard ORDER BY t, event_id) AS BIGINT) % 100000) / 100.0 AS v FROM e",
}


def _grid(instant: bool) -> str:
    return f"g AS (SELECT {AT} AS g)" if instant else f"g AS (SELECT {START} + i * {STEP} AS g FROM range({(END - START) // STEP + 1}) r(i))"


def _sel(metric: str = "event_value", where: str = "true", offset: int = 0, instant: bool = False, name: str = "sel", at: int | None = None) -> str:
    """CTEs up to ``sel(g, event_type, shard, v, ot)``: the latest sample in the lookback."""
    t = f"g.g - {offset}" if at is None else f"{at - offset}"
    return f"""WITH {_EVENTS}, {_grid(instant)}, s AS ({_METRIC[metric]}),
{name} AS (SELECT g.g, event_type, shard, arg_max(v, t) AS v, max(t) AS ot FROM g JOIN s ON t > {t} - {6 * H} AND t <= {t} WHERE {where} GROUP BY ALL)"""


def _out(cte: str, labels: str, value: str, tail: str = "FROM sel") -> str:
    return f"{cte} SELECT {labels} AS labels, g AS ts_ns, round(CAST({value} AS DOUBLE), 6) AS value {tail}"


def _win(metric: str, hours: int, value: str, having: str = "", instant: bool = False, labels: str = _JSON, extra: str = "") -> str:
    """One aggregate over each series' window."""
    return f"""WITH {_EVENTS}, {_grid(instant)}, s AS ({_METRIC[metric]}),
w AS (SELECT g.g, s.*, lag(v) OVER (PARTITION BY g.g, event_type, shard ORDER BY t) AS p, lag(t) OVER (PARTITION BY g.g, event_type, shard ORDER BY t) AS pt
      FROM g JOIN s ON t > g.g - {hours * H} AND t <= g.g){extra}
SELECT {labels} AS labels, g AS ts_ns, round(CAST({value} AS DOUBLE), 6) AS value FROM w GROUP BY g, event_type, shard {having}"""


def _rate(metric: str, hours: int, counter: bool, per_second: bool) -> str:
    lost = "sum(CASE WHEN v < p THEN p ELSE 0 END)" if counter else "0.0"
    clamp = "CASE WHEN inc > 0 AND v0 >= 0 AND span * v0 / inc < d0 THEN span * v0 / inc ELSE d0 END" if counter else "d0"
    return f"""WITH {_EVENTS}, {_grid(False)}, s AS ({_METRIC[metric]}),
w AS (SELECT g.g, s.*, lag(v) OVER (PARTITION BY g.g, event_type, shard ORDER BY t) AS p FROM g JOIN s ON t > g.g - {hours * H} AND t <= g.g),
a AS (SELECT g, event_type, shard, count(*) AS n, arg_min(v, t) AS v0, arg_max(v, t) AS v1, {lost} AS lost, min(t) AS t0, max(t) AS t1 FROM w GROUP BY ALL HAVING count(*) > 1),
b AS (SELECT *, v1 - v0 + lost AS inc, ((t0 - g + {hours * H}) // 1000000) / 1000.0 AS d0, ((g - t1) // 1000000) / 1000.0 AS d1, ((t1 - t0) // 1000000) / 1000.0 AS span FROM a),
c AS (SELECT *, {clamp} AS e0, span / (n - 1) AS mean FROM b)
SELECT {_JSON} AS labels, g AS ts_ns, round(inc * (span + CASE WHEN e0 < mean * 1.1 THEN e0 ELSE mean / 2 END + CASE WHEN d1 < mean * 1.1 THEN d1 ELSE mean / 2 END) / span{f" / {hours * 3600}.0" if per_second else ""}, 6) AS value FROM c"""


def _hist(value: str, kind: str) -> str:
    """Hourly native histograms of the events' values: base-2 buckets, the latest in the lookback."""
    tail = {
        "total": f"SELECT {_KIND} AS labels, g AS ts_ns, round(CAST({value} AS DOUBLE), 6) AS value FROM sel",
        "merged": f"SELECT '{{}}' AS labels, g AS ts_ns, round(CAST({value} AS DOUBLE), 6) AS value FROM sel GROUP BY g",
        "fraction": f"SELECT {_KIND} AS labels, g AS ts_ns, round(CAST({value} AS DOUBLE), 6) AS value FROM c GROUP BY g, event_type",
        "quantile": f"SELECT {_KIND} AS labels, g AS ts_ns, round(CAST({value} AS DOUBLE), 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY g, event_type ORDER BY i) AS r FROM c WHERE below + c >= 0.3 * n) WHERE r = 1",
    }[kind]
    return f"""WITH {_EVENTS}, {_grid(False)}, b AS (SELECT event_type, (t // {H} + 1) * {H} AS ht, CAST(ceil(log2(value)) AS INTEGER) AS i, count(*) AS c, sum(value) AS bs FROM e WHERE value > 0 GROUP BY ALL),
h AS (SELECT event_type, ht, sum(c) AS n, sum(bs) AS s FROM b GROUP BY ALL),
last AS (SELECT g.g, event_type, max(ht) AS ht FROM g JOIN h ON ht > g.g - {6 * H} AND ht <= g.g GROUP BY ALL),
sel AS (SELECT * FROM last JOIN h USING (event_type, ht)),
c AS (SELECT sel.g, event_type, sel.n, i, c, sum(c) OVER (PARTITION BY sel.g, event_type ORDER BY i) - c AS below FROM sel JOIN b USING (event_type, ht)) {tail}"""


_N = _NAMED % "event_value"
_KIND = """'{"event_type":"' || event_type || '"}'"""
_TYPE = """'{"event_type":"' || event_type || '"}'"""
_SHARD = """'{"shard":"' || shard || '"}'"""

#: name: (PromQL, SQL or None[, "instant"])
QUERIES: dict[str, tuple] = {
    "promql_selector": ("event_value", _out(_sel(), _N, "v")),
    "promql_match_eq": ('event_value{event_type="error"}', _out(_sel(where="event_type = 'error'"), _N, "v")),
    "promql_match_ne": ('event_value{event_type!="error"}', _out(_sel(where="event_type <> 'error'"), _N, "v")),
    "promql_match_re": ('event_value{event_type=~"e.*|view"}', _out(_sel(where="regexp_full_match(event_type, 'e.*|view')"), _N, "v")),
    "promql_match_nre": ('event_value{event_type!~"e.*|view",shard!="0"}', _out(_sel(where="NOT regexp_full_match(event_type, 'e.*|view') AND shard <> '0'"), _N, "v")),
    "promql_match_absent_label": ('event_value{nolabel=""}', _out(_sel(), _N, "v")),
    "promql_name_regex": ('{__name__=~"event_v.*"}', _out(_sel(), _N, "v")),
    "promql_offset": ("event_value offset 3h", _out(_sel(offset=3 * H), _N, "v")),
    "promql_offset_negative": ("event_value offset -3h", _out(_sel(offset=-3 * H), _N, "v")),
    "promql_at": (f"event_value @ {AT // 10**9}", _out(_sel(at=AT), _N, "v")),
    "promql_at_end": ("event_value @ end()", _out(_sel(at=END), _N, "v")),
    "promql_at_start": ("event_value @ start()", _out(_sel(at=START), _N, "v")),
    "promql_stale": ("flaky_value", f"""WITH {_EVENTS}, {_grid(False)}, s AS (SELECT event_type, shard, t, value AS v, event_id % 4 = 0 AS stale FROM e),
sel AS (SELECT g.g, event_type, shard, arg_max(v, t) AS v, arg_max(stale, t) AS stale FROM g JOIN s ON t > g.g - {6 * H} AND t <= g.g GROUP BY ALL)
SELECT {_NAMED % "flaky_value"} AS labels, g AS ts_ns, round(v, 6) AS value FROM sel WHERE NOT stale"""),
    "promql_native_count": ("histogram_count(value_native)", _hist("n", "total")),
    "promql_native_sum": ("histogram_sum(value_native)", _hist("s", "total")),
    "promql_native_avg": ("histogram_avg(value_native)", _hist("s / n", "total")),
    "promql_native_merged": ("histogram_count(sum(value_native))", _hist("sum(n)", "merged")),
    "promql_native_quantile": ("histogram_quantile(0.3, value_native)", _hist("pow(2, i - 1 + (0.3 * n - below) / c)", "quantile")),
    "promql_native_fraction": ("histogram_fraction(0, 64, value_native)", _hist("sum(CASE WHEN i <= 6 THEN c ELSE 0 END) / any_value(n)", "fraction")),
    "promql_instant": ("event_value", _out(_sel(instant=True), _N, "v"), "instant"),
    "promql_timestamp": ("timestamp(event_value)", _out(_sel(), _JSON, "ot / 1e9")),
    "promql_rate": ("rate(events_value_total[12h])", _rate("events_value_total", 12, True, True)),
    "promql_increase": ("increase(events_value_total[12h])", _rate("events_value_total", 12, True, False)),
    "promql_delta": ("delta(event_value[12h])", _rate("event_value", 12, False, False)),
    "promql_irate": ("irate(events_value_total[12h])", _win("events_value_total", 12, "arg_max(CASE WHEN v < p THEN v ELSE v - p END / ((t - pt) / 1e9), t)", "HAVING count(*) > 1")),
    "promql_idelta": ("idelta(event_value[12h])", _win("event_value", 12, "arg_max(v - p, t)", "HAVING count(*) > 1")),
    "promql_resets": ("resets(events_value_total[1d])", _win("events_value_total", 24, "count(*) FILTER (v < p)")),
    "promql_changes": ("changes(event_value[12h])", _win("event_value", 12, "count(*) FILTER (v <> p)")),
    "promql_deriv": ("deriv(event_value[12h])", _win("event_value", 12, "CASE WHEN min(v) = max(v) THEN 0 ELSE regr_slope(v, (t - g) / 1e9) END", "HAVING count(*) > 1")),
    "promql_predict_linear": ("predict_linear(event_value[12h], 600)", _win("event_value", 12, "CASE WHEN min(v) = max(v) THEN min(v) ELSE regr_slope(v, (t - g) / 1e9) * 600 + regr_intercept(v, (t - g) / 1e9) END", "HAVING count(*) > 1")),
    **{f"promql_{f}_over_time": (f"{f}_over_time(event_value[12h])", _win("event_value", 12, sql)) for f, sql in {"avg": "avg(v)", "min": "min(v)", "max": "max(v)", "sum": "sum(v)", "count": "count(*)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)", "present": "1"}.items()},
    "promql_last_over_time": ("last_over_time(event_value[12h])", _win("event_value", 12, "arg_max(v, t)", labels=_N)),
    "promql_quantile_over_time": ("quantile_over_time(0.3, event_value[12h])", _win("event_value", 12, "quantile_cont(v, 0.3)")),
    "promql_absent_over_time": ('absent_over_time(event_value{event_type="purchase",shard="1"}[1h])', f"""WITH {_EVENTS}, {_grid(False)} SELECT '{{"event_type":"purchase","shard":"1"}}' AS labels, g AS ts_ns, CAST(1 AS DOUBLE) AS value FROM g WHERE NOT EXISTS (SELECT 1 FROM e WHERE event_type = 'purchase' AND shard = '1' AND t > g.g - {H} AND t <= g.g)"""),
    "promql_absent": ('absent(event_value{event_type="none"})', f"""WITH {_grid(False)} SELECT '{{"event_type":"none"}}' AS labels, g AS ts_ns, CAST(1 AS DOUBLE) AS value FROM g"""),
    "promql_subquery": ("max_over_time(event_value[1d:3h])", f"""WITH {_EVENTS}, {_grid(False)}, i AS (SELECT (({START} - {24 * H}) // {3 * H} + 1 + i) * {3 * H} AS it FROM range({(END - START + 24 * H) // (3 * H)}) r(i)),
s AS (SELECT it, event_type, shard, arg_max(value, t) AS v FROM i JOIN e ON t > it - {6 * H} AND t <= it GROUP BY ALL)
SELECT {_JSON} AS labels, g AS ts_ns, round(max(v), 6) AS value FROM g JOIN s ON it > g.g - {24 * H} AND it <= g.g GROUP BY g, event_type, shard"""),
    **{f"promql_agg_{f}": (f"{f} by (event_type) (event_value)", _out(_sel(), _TYPE, sql, "FROM sel GROUP BY g, event_type")) for f, sql in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "count(*)", "group": "1", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items()},
    "promql_agg_quantile": ("quantile by (event_type) (0.9, event_value)", _out(_sel(), _TYPE, "quantile_cont(v, 0.9)", "FROM sel GROUP BY g, event_type")),
    "promql_agg_without": ("sum without (event_type) (event_value)", _out(_sel(), _SHARD, "sum(v)", "FROM sel GROUP BY g, shard")),
    "promql_agg_all": ("avg(event_value)", _out(_sel(), "'{}'", "avg(v)", "FROM sel GROUP BY g")),
    "promql_count_values": ('count_values by (event_type) ("v", floor(event_value / 50))', _out(_sel(), """'{"event_type":"' || event_type || '","v":"' || CAST(floor(v / 50) AS BIGINT) || '"}'""", "count(*)", "FROM sel GROUP BY g, event_type, floor(v / 50)")),
    "promql_topk": ("topk by (event_type) (2, event_value)", _out(_sel(), _N, "v", f"FROM (SELECT *, row_number() OVER (PARTITION BY g, event_type ORDER BY v DESC, {_N}) AS r FROM sel) WHERE r <= 2")),
    "promql_bottomk": ("bottomk(3, event_value)", _out(_sel(), _N, "v", f"FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v, {_N}) AS r FROM sel) WHERE r <= 3")),
    "promql_sum_rate": ("sum by (event_type) (rate(events_value_total[12h]))", f"SELECT regexp_replace(labels, ',\"shard\":\"[0-9]\"', '') AS labels, ts_ns, round(sum(v), 6) AS value FROM ({_rate('events_value_total', 12, True, True).replace(', 6) AS value', ', 15) AS v')}) GROUP BY ALL"),
    **{f"promql_op_{n}": (f"event_value {op} 7", _out(_sel(), _JSON, sql)) for n, op, sql in (("add", "+", "v + 7"), ("sub", "-", "v - 7"), ("mul", "*", "v * 7"), ("div", "/", "v / 7"), ("mod", "%", "fmod(v, 7)"), ("atan2", "atan2", "atan2(v, 7)"))},
    "promql_op_pow": ("event_value ^ 2 ^ 0.5", _out(_sel(), _JSON, "pow(v, pow(2, 0.5))")),
    "promql_op_div_zero": ("event_value / 0 > 1", _out(_sel(), _JSON, "v / 0")),
    **{f"promql_cmp_{n}": (f"event_value {op} 50", _out(_sel(), _N, "v", f"FROM sel WHERE v {op} 50")) for n, op in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<="), ("ne", "!="))},
    "promql_cmp_eq": ("floor(event_value) == 12", _out(_sel(), _JSON, "12", "FROM sel WHERE floor(v) = 12")),
    "promql_cmp_bool": ("event_value > bool 50", _out(_sel(), _JSON, "CASE WHEN v > 50 THEN 1 ELSE 0 END")),
    "promql_unary": ("-event_value", _out(_sel(), _JSON, "-v")),
    "promql_precedence": ("-event_value + 2 * 3 - 1", _out(_sel(), _JSON, "-v + 5")),
    "promql_vv_one_to_one": ("event_value / max_over_time(event_value[1d])", f"""{_sel()}, m AS (SELECT g.g, event_type, shard, max(v) AS m FROM g JOIN s ON t > g.g - {24 * H} AND t <= g.g GROUP BY ALL)
SELECT {_JSON} AS labels, g AS ts_ns, round(v / m, 6) AS value FROM sel JOIN m USING (g, event_type, shard)"""),
    "promql_vv_on": ('event_value{shard="1"} - on (event_type) event_value{shard="2"}', _out(_sel(), """'{"event_type":"' || a.event_type || '"}'""", "a.v - b.v", "FROM sel a JOIN sel b USING (g, event_type) WHERE a.shard = '1' AND b.shard = '2'")),
    "promql_vv_ignoring": ('event_value{shard="1"} * ignoring (shard) event_value{shard="2"}', _out(_sel(), """'{"event_type":"' || a.event_type || '"}'""", "a.v * b.v", "FROM sel a JOIN sel b USING (g, event_type) WHERE a.shard = '1' AND b.shard = '2'")),
    "promql_vv_filter": ('event_value{shard="1"} > ignoring (shard) event_value{shard="2"}', _out(_sel(), """'{"__name__":"event_value","event_type":"' || a.event_type || '"}'""", "a.v", "FROM sel a JOIN sel b USING (g, event_type) WHERE a.shard = '1' AND b.shard = '2' AND a.v > b.v")),
    "promql_group_left": ("event_value / on (event_type) group_left sum by (event_type) (event_value)", _out(_sel(), _JSON, "v / total", "FROM (SELECT *, sum(v) OVER (PARTITION BY g, event_type) AS total FROM sel)")),
    "promql_group_left_label": ('event_value{shard="1"} * on (event_type) group_left (shard) event_value{shard="3"}', _out(_sel(), """'{"event_type":"' || a.event_type || '","shard":"3"}'""", "a.v * b.v", "FROM sel a JOIN sel b USING (g, event_type) WHERE b.shard = '3' AND a.shard = '0'").replace("a.shard = '0'", "a.shard = '1'")),
    "promql_group_right": ("sum by (event_type) (event_value) - on (event_type) group_right event_value", _out(_sel(), _JSON, "total - v", "FROM (SELECT *, sum(v) OVER (PARTITION BY g, event_type) AS total FROM sel)")),
    "promql_and": ("event_value and event_value > 50", _out(_sel(), _N, "v", "FROM sel WHERE v > 50")),
    "promql_unless": ("event_value unless event_value > 50", _out(_sel(), _N, "v", "FROM sel WHERE v <= 50")),
    "promql_or": ('event_value{shard="1"} or event_value{event_type="view"}', _out(_sel(), _N, "v", "FROM sel WHERE shard = '1' OR event_type = 'view'")),
    "promql_or_on": ('event_value{shard="1"} or on (event_type) event_value{shard="2"}', _out(_sel(), _N, "v", "FROM sel WHERE shard = '1' OR (shard = '2' AND NOT EXISTS (SELECT 1 FROM sel b WHERE b.g = sel.g AND b.event_type = sel.event_type AND b.shard = '1'))")),
    **{f"promql_{f}": (f"{f}({x.replace('v', 'event_value')})", _out(_sel(), _JSON, sql.replace("$", f"({x})"))) for f, x, sql in (
        ("abs", "50 - v", "abs($)"), ("ceil", "v / 7", "ceil($)"), ("floor", "v / 7", "floor($)"), ("sqrt", "v", "sqrt($)"), ("exp", "v / 100", "exp($)"), ("ln", "v", "ln($)"), ("log2", "v", "log2($)"), ("log10", "v", "log10($)"), ("sgn", "v - 50", "sign($)"),
        ("sin", "v", "sin($)"), ("cos", "v", "cos($)"), ("tan", "v / 500", "tan($)"), ("asin", "v / 500", "asin($)"), ("acos", "v / 500", "acos($)"), ("atan", "v", "atan($)"), ("sinh", "v / 100", "sinh($)"), ("cosh", "v / 100", "cosh($)"), ("tanh", "v / 100", "tanh($)"),
        ("asinh", "v", "asinh($)"), ("acosh", "v + 1", "acosh($)"), ("atanh", "v / 500", "atanh($)"), ("deg", "v", "degrees($)"), ("rad", "v", "radians($)"),
    )},
    "promql_round": ("round(event_value)", _out(_sel(), _JSON, "floor(v + 0.5)")),
    "promql_round_to": ("round(event_value, 5)", _out(_sel(), _JSON, "floor(v * 0.2 + 0.5) / 0.2")),
    "promql_clamp": ("clamp(event_value, 20, 60)", _out(_sel(), _JSON, "greatest(least(v, 60), 20)")),
    "promql_clamp_min": ("clamp_min(event_value, 20)", _out(_sel(), _JSON, "greatest(v, 20)")),
    "promql_clamp_max": ("clamp_max(event_value, 60)", _out(_sel(), _JSON, "least(v, 60)")),
    "promql_time": ("time() + 1", f"WITH {_grid(False)} SELECT '{{}}' AS labels, g AS ts_ns, g / 1e9 + 1 AS value FROM g"),
    "promql_pi": ("pi()", f"WITH {_grid(False)} SELECT '{{}}' AS labels, g AS ts_ns, round(pi(), 6) AS value FROM g"),
    "promql_vector": ("vector(3)", f"WITH {_grid(False)} SELECT '{{}}' AS labels, g AS ts_ns, CAST(3 AS DOUBLE) AS value FROM g"),
    "promql_scalar": ("event_value * scalar(sum(event_value))", _out(_sel(), _JSON, "v * total", "FROM (SELECT *, sum(v) OVER (PARTITION BY g) AS total FROM sel)")),
    **{f"promql_{f}": (f"{f}(timestamp(event_value))", _out(_sel(), _JSON, sql.replace("$", "make_timestamp(CAST(ot // 1000 AS BIGINT))"))) for f, sql in {"minute": "minute($)", "hour": "hour($)", "day_of_week": "dayofweek($)", "day_of_month": "day($)", "day_of_year": "dayofyear($)", "days_in_month": "day(last_day($))", "month": "month($)", "year": "year($)"}.items()},
    "promql_label_replace": ('label_replace(event_value, "kind", "$1-x", "event_type", "(e|v)(.*)")', _out(_sel(), """CASE WHEN regexp_full_match(event_type, '(e|v).*') THEN '{"__name__":"event_value","event_type":"' || event_type || '","kind":"' || substr(event_type, 1, 1) || '-x","shard":"' || shard || '"}' ELSE """ + _N + " END", "v")),
    "promql_label_join": ('label_join(event_value, "both", "/", "event_type", "shard")', _out(_sel(), """'{"__name__":"event_value","both":"' || event_type || '/' || shard || '","event_type":"' || event_type || '","shard":"' || shard || '"}'""", "v")),
    "promql_sort": ("sort(event_value)", _out(_sel(instant=True), _N, "v"), "instant"),
    "promql_sort_desc": ("sort_desc(event_value)", _out(_sel(instant=True), _N, "v"), "instant"),
}

_BUCKETS = f"""WITH {_EVENTS}, {_grid(False)}, c AS (SELECT event_type, t, {", ".join(f"sum(CASE WHEN value <= {b} THEN 1 ELSE 0 END) OVER w AS c{i}" for i, b in enumerate((10, 50, 100, 200)))}, count(*) OVER w AS c4 FROM e WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
l AS (SELECT g.g, event_type, arg_max(c, t) AS c FROM g JOIN c ON t > g.g - {6 * H} AND t <= g.g GROUP BY ALL),
b AS (SELECT g, event_type, c.c0 AS c0, c.c1 AS c1, c.c2 AS c2, c.c3 AS c3, c.c4 AS n FROM l)"""
QUERIES["promql_histogram_quantile"] = ("histogram_quantile(0.7, value_bucket)", f"""{_BUCKETS}, q AS (SELECT *, 0.7 * n AS r FROM b) SELECT {_TYPE} AS labels, g AS ts_ns, round(CAST(CASE WHEN c0 >= r THEN 10 * r / c0 WHEN c1 >= r THEN 10 + 40 * (r - c0) / (c1 - c0) WHEN c2 >= r THEN 50 + 50 * (r - c1) / (c2 - c1) WHEN c3 >= r THEN 100 + 100 * (r - c2) / (c3 - c2) ELSE 200 END AS DOUBLE), 6) AS value FROM q""")
QUERIES["promql_histogram_fraction"] = ("histogram_fraction(20, 100, value_bucket)", f"{_BUCKETS} SELECT {_TYPE} AS labels, g AS ts_ns, round(CAST((c2 - (c0 + (c1 - c0) * 10 / 40.0)) / n AS DOUBLE), 6) AS value FROM b")


def _runner(name: str):
    query, _, *mode = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine.open(spark, sf_dir)
        df = engine.promql(query, AT, LOOKBACK) if mode else engine.promql_range(query, START, END, STEP, LOOKBACK)
        return df.withColumn("value", F.round("value", 6))

    return run


_MATCH = ['event_value{event_type="error"}', 'event_value{shard="1"}']
_FOUND = f"FROM (SELECT event_type, CAST(user_id % 4 AS VARCHAR) AS shard, epoch_us(ts) * 1000 AS t FROM events) WHERE (event_type = 'error' OR shard = '1') AND t BETWEEN {START} AND {END}"


def queries() -> dict:
    """All queries by name."""
    found = {name: _runner(name) for name in QUERIES}
    opened = Engine.open
    found["meta_series"] = lambda s, d: opened(s, d).series(_MATCH, START, END)
    found["meta_label_names"] = lambda s, d: opened(s, d).label_names(_MATCH, START, END)
    found["meta_label_values"] = lambda s, d: opened(s, d).label_values("event_type", _MATCH, START, END)
    found["meta_metadata"] = lambda s, d: opened(s, d).metadata()
    found["exemplar_query"] = lambda s, d: opened(s, d).exemplars('event_value{shard=~"1|2"}', START, END)
    return found


def oracle_sql() -> dict[str, str]:
    """SQL by name."""
    found = {name: q[1] for name, q in QUERIES.items()}
    found["meta_series"] = f"SELECT DISTINCT {_N} AS labels {_FOUND}"
    found["meta_label_names"] = "SELECT * FROM (VALUES ('__name__'), ('event_type'), ('shard')) v(name)"
    found["meta_label_values"] = f"SELECT DISTINCT event_type AS value {_FOUND}"
    found["meta_metadata"] = "SELECT * FROM (VALUES ('event_value', 'gauge', 'Value of an event', ''), ('events_value_total', 'counter', 'Sum of values', ''), ('value_bucket', 'histogram', 'Values by bound', '')) v(metric, type, help, unit)"
    found["exemplar_query"] = f"""WITH {_EVENTS} SELECT event_type, shard, max(t) AS ts_ns, arg_max(value, (t, event_id)) AS value, md5(CAST(arg_max(event_id, (t, event_id)) AS VARCHAR)) AS trace_id
FROM e WHERE event_type = 'error' AND shard IN ('1', '2') GROUP BY event_type, shard, t // 10000000000 HAVING max(t) BETWEEN {START} AND {END}"""
    return found
