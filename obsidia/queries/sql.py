"""SQL queries over the signal tables; where the dialects agree the oracle is the same text over tables made in place."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from obsidia.sql.engine import run

_CTES = {
    "samples": "samples AS (SELECT epoch_us(ts) * 1000 AS ts_ns, ts, value, event_type, CAST(user_id % 4 AS VARCHAR) AS shard, md5('{\"__name__\":\"event_value\",\"event_type\":\"' || event_type || '\",\"shard\":\"' || user_id % 4 || '\"}') AS series_id FROM events)",
    "logs": "logs AS (SELECT epoch_us(ts) * 1000 AS ts_ns, ts, ts AS observed_ts, CASE WHEN event_type = 'error' THEN 17 ELSE 9 END AS severity_num, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity_text, event_type || ' ' || props AS body, md5(CAST(event_id AS VARCHAR)) AS trace_id, CAST(NULL AS VARCHAR) AS span_id, CAST(0 AS BIGINT) AS flags, CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)",
    "spans": "spans AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS trace_id, substr(md5(l_orderkey || '-' || l_linenumber), 1, 16) AS span_id, CASE WHEN l_linenumber > 1 THEN substr(md5(l_orderkey || '-1'), 1, 16) END AS parent_span_id, l_returnflag || l_linestatus AS name, least(o_orderdate, l_shipdate) AS start_ts, greatest(o_orderdate, l_shipdate) AS end_ts, CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS status_code, CASE WHEN l_returnflag = 'R' THEN 'returned' END AS status_message, o_orderpriority AS service_name, CAST(l_suppkey AS VARCHAR) AS supplier, (epoch_us(greatest(o_orderdate, l_shipdate)) - epoch_us(least(o_orderdate, l_shipdate))) * 1000 AS duration_ns FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "alerts": "alerts AS (SELECT epoch_us(ts) * 1000 AS ts_ns, md5(CAST(user_id AS VARCHAR)) AS alert_id, 'errors-' || user_id % 4 AS rule_id, CASE WHEN event_id % 2 = 0 THEN 'firing' ELSE 'resolved' END AS state, CAST(user_id % 3 AS BIGINT) AS generation, CAST(user_id AS VARCHAR) AS usr FROM events WHERE event_type = 'error')",
    "audit": "audit AS (SELECT epoch_us(o_orderdate) * 1000 AS ts_ns, 'INFO' AS severity_text, CASE WHEN o_orderstatus = 'O' THEN 'put' ELSE 'lift' END AS op, 'customer/' || o_custkey AS scope, o_orderpriority AS reason FROM orders)",
    "logs_text": "logs_text AS (SELECT doc_id, text AS body, lang, source FROM documents)",
}

_W = "OVER (PARTITION BY label(labels, 'event_type') ORDER BY ts_ns, series_id, value)"
_WORDS = "array_to_string(list_filter(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ')"

#: name: query, or (query, oracle's query over the same tables)
QUERIES: dict[str, str | tuple[str, str]] = {
    "sql_project": "SELECT ts_ns, value * 2 AS doubled, label(labels, 'shard') AS shard FROM samples",
    "sql_filter": "SELECT ts_ns, value FROM samples WHERE value > 100 AND label(labels, 'event_type') = 'error'",
    "sql_in_list": "SELECT ts_ns, value FROM samples WHERE label(labels, 'shard') IN ('1', '3')",
    "sql_between": "SELECT ts_ns, value FROM samples WHERE value BETWEEN 10 AND 20",
    "sql_case": "SELECT CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END AS band, count(*) AS n FROM samples GROUP BY 1",
    "sql_like": "SELECT ts_ns, body FROM logs WHERE body LIKE 'err%7}'",
    "sql_ilike": "SELECT count(*) AS n FROM logs WHERE body ILIKE 'VIEW%' AND body NOT LIKE '%5}'",
    "sql_label_match": ("SELECT label(labels, 'event_type') AS event_type, count(*) AS n FROM samples WHERE label_match(labels, 'event_type', 'e.*|v.*') GROUP BY 1", "SELECT event_type, count(*) AS n FROM samples WHERE regexp_full_match(event_type, 'e.*|v.*') GROUP BY 1"),
    "sql_count_sum_min_max_avg": "SELECT series_id, count(*) AS n, count(value) AS nv, round(sum(value), 4) AS s, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS a FROM samples GROUP BY series_id",
    "sql_count_distinct": "SELECT count(DISTINCT label(labels, 'event_type')) AS kinds, count(DISTINCT series_id) AS series FROM samples",
    "sql_group_ordinal": "SELECT label(labels, 'event_type') AS event_type, label(labels, 'shard') AS shard, count(*) AS n FROM samples GROUP BY 1, 2",
    "sql_group_all": "SELECT label(labels, 'event_type') AS event_type, count(*) AS n FROM samples GROUP BY ALL",
    "sql_having": "SELECT series_id, count(*) AS n FROM samples GROUP BY series_id HAVING count(*) > 100",
    "sql_distinct": "SELECT DISTINCT label(labels, 'event_type') AS event_type FROM samples",
    "sql_order_limit_offset": "SELECT ts_ns, value FROM samples ORDER BY value DESC NULLS LAST, ts_ns LIMIT 20 OFFSET 5",
    "sql_topk": "SELECT ts_ns, value FROM samples ORDER BY value DESC, ts_ns LIMIT 10",
    "sql_union": "SELECT label(labels, 'shard') AS x FROM samples UNION SELECT label(labels, 'event_type') AS x FROM samples",
    "sql_union_all": "SELECT value FROM samples WHERE value > 300 UNION ALL SELECT value FROM samples WHERE value > 310",
    "sql_intersect": "SELECT value FROM samples WHERE label(labels, 'shard') = '1' INTERSECT SELECT value FROM samples WHERE label(labels, 'shard') = '2'",
    "sql_except": "SELECT value FROM samples WHERE label(labels, 'shard') = '1' EXCEPT SELECT value FROM samples WHERE label(labels, 'shard') = '2'",
    "sql_cte": "WITH big AS (SELECT * FROM samples WHERE value > 200) SELECT label(labels, 'event_type') AS event_type, count(*) AS n FROM big GROUP BY 1",
    "sql_derived_table": "SELECT event_type, max(n) AS most FROM (SELECT label(labels, 'event_type') AS event_type, label(labels, 'shard') AS shard, count(*) AS n FROM samples GROUP BY 1, 2) t GROUP BY event_type",
    "sql_exists": "SELECT count(*) AS n FROM samples a WHERE EXISTS (SELECT 1 FROM samples b WHERE b.series_id = a.series_id AND b.value > 400)",
    "sql_in_subquery": "SELECT count(*) AS n FROM samples WHERE series_id IN (SELECT series_id FROM samples WHERE value > 400)",
    "sql_scalar_subquery": "SELECT ts_ns, value FROM samples WHERE value = (SELECT max(value) FROM samples)",
    "sql_self_join": "SELECT count(*) AS n FROM samples a JOIN samples b ON a.series_id = b.series_id AND a.value = b.value AND a.ts_ns < b.ts_ns",
    "sql_agg_filter": "SELECT label(labels, 'event_type') AS event_type, count(*) FILTER (WHERE value > 100) AS n FROM samples GROUP BY 1",
    "sql_rollup": "SELECT label(labels, 'event_type') AS event_type, label(labels, 'shard') AS shard, count(*) AS n FROM samples GROUP BY ROLLUP (1, 2)",
    "sql_row_number": f"SELECT ts_ns, series_id, cast(row_number() {_W} as bigint) AS r FROM samples",
    "sql_rank": "SELECT series_id, value, cast(rank() OVER (PARTITION BY series_id ORDER BY value) as bigint) AS r, cast(dense_rank() OVER (PARTITION BY series_id ORDER BY value) as bigint) AS d FROM samples",
    "sql_ntile": f"SELECT ts_ns, series_id, cast(ntile(4) {_W} as bigint) AS q FROM samples",
    "sql_lag_lead": f"SELECT ts_ns, series_id, lag(value) {_W} AS p, lead(value, 2) {_W} AS f FROM samples",
    "sql_cume_percent": "SELECT series_id, value, round(cume_dist() OVER (PARTITION BY series_id ORDER BY value), 9) AS c, round(percent_rank() OVER (PARTITION BY series_id ORDER BY value), 9) AS p FROM samples",
    "sql_frame_growing": f"SELECT ts_ns, series_id, round(sum(value) {_W}, 4) AS s, count(*) {_W} AS n FROM samples",
    "sql_frame_moving": "SELECT ts_ns, series_id, min(value) OVER (PARTITION BY series_id ORDER BY ts_ns ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS lo, max(value) OVER (PARTITION BY series_id ORDER BY ts_ns ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS hi FROM samples",
    "sql_date_trunc": ("SELECT timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(date_trunc('hour', ts) as timestamp_ntz)) AS hour_s, count(*) AS n FROM logs GROUP BY 1", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_s, count(*) AS n FROM logs GROUP BY 1"),
    "sql_date_bin": ("SELECT date_bin_us(900000000, ts_ns div 1000, 0) AS bin_us, count(*) AS n FROM logs GROUP BY 1", "SELECT (ts_ns // 1000) // 900000000 * 900000000 AS bin_us, count(*) AS n FROM logs GROUP BY 1"),
    "sql_date_part": ("SELECT cast(date_part('hour', ts) as bigint) AS h, cast(date_part('day', ts) as bigint) AS d, count(*) AS n FROM logs GROUP BY 1, 2", "SELECT date_part('hour', ts) AS h, date_part('day', ts) AS d, count(*) AS n FROM logs GROUP BY 1, 2"),
    "sql_calendar": ("SELECT ts_ns, year(ts) AS y, cast(to_date(ts) as string) AS day, to_unixtime(ts) AS u FROM logs", "SELECT ts_ns, CAST(year(ts) AS INTEGER) AS y, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, epoch_us(ts) // 1000000 AS u FROM logs"),
    "sql_math": "SELECT ts_ns, abs(value - 50) AS a, cast(ceil(value) as double) AS c, cast(floor(value) as double) AS f, round(sqrt(value), 6) AS s, round(exp(value / 100), 4) AS e, round(ln(value), 6) AS l, round(log10(value), 6) AS l10, round(log2(value), 6) AS l2, round(power(value, 2), 4) AS p, round(cbrt(value), 6) AS cb FROM samples",
    "sql_trigonometry": "SELECT ts_ns, round(sin(value), 6) AS s, round(cos(value), 6) AS c, round(atan(value), 6) AS a, round(atan2(value, 2), 6) AS a2, round(degrees(value), 6) AS d, round(radians(value), 6) AS r, round(cot(value), 3) AS ct, round(pi(), 9) AS pi FROM samples",
    "sql_hyperbolic": "SELECT ts_ns, round(tanh(value / 100), 6) AS t, round(sinh(value / 100), 6) AS s, round(cosh(value / 100), 6) AS c, round(asinh(value), 6) AS a FROM samples",
    "sql_integers": ("SELECT k, gcd(k, 36) AS g, lcm(k, 6) AS l, to_hex(k) AS h, factorial(cast(k % 10 as int)) AS f, iszero(k) AS z FROM logs", "SELECT k, gcd(k, 36) AS g, CAST(lcm(k, 6) AS BIGINT) AS l, lower(to_hex(k)) AS h, CAST(factorial(CAST(k % 10 AS INTEGER)) AS BIGINT) AS f, k = 0 AS z FROM logs"),
    "sql_trunc": ("SELECT ts_ns, truncate_to(value, 1) AS t FROM samples", "SELECT ts_ns, sign(value) * floor(abs(value) * 10) / 10 AS t FROM samples"),
    "sql_greatest_least": "SELECT ts_ns, greatest(value, 50) AS g, least(value, 50) AS l, coalesce(nullif(value, 1.63), -1) AS c FROM samples",
    "sql_null_functions": ("SELECT ts_ns, nvl(span_id, 'none') AS a, nvl2(span_id, 'x', 'y') AS b, ifnull(span_id, body) AS c, span_id IS NULL AS d FROM logs", "SELECT ts_ns, coalesce(span_id, 'none') AS a, CASE WHEN span_id IS NOT NULL THEN 'x' ELSE 'y' END AS b, ifnull(span_id, body) AS c, span_id IS NULL AS d FROM logs"),
    "sql_string_case": ("SELECT body, upper(body) AS u, lower(body) AS l, initcap(severity_text) AS i, reverse(body) AS r FROM logs", "SELECT body, upper(body) AS u, lower(body) AS l, upper(severity_text[1]) || lower(severity_text[2:]) AS i, reverse(body) AS r FROM logs"),
    "sql_string_length": ("SELECT body, length(body) AS n, char_length(body) AS c, octet_length(body) AS o, bit_length(body) AS b, ascii(body) AS a FROM logs", "SELECT body, CAST(length(body) AS INTEGER) AS n, CAST(length(body) AS INTEGER) AS c, CAST(strlen(body) AS INTEGER) AS o, CAST(bit_length(body) AS INTEGER) AS b, ascii(body) AS a FROM logs"),
    "sql_string_cut": ("SELECT body, left(body, 3) AS l, right(body, 4) AS r, substr(body, 2, 3) AS s, split_part(body, ' ', 2) AS p, substring_index(body, ' ', 1) AS i, overlay(body placing 'ZZ' from 2 for 3) AS o FROM logs", "SELECT body, left(body, 3) AS l, right(body, 4) AS r, substr(body, 2, 3) AS s, split_part(body, ' ', 2) AS p, split_part(body, ' ', 1) AS i, left(body, 1) || 'ZZ' || substr(body, 5) AS o FROM logs"),
    "sql_string_search": ("SELECT body, strpos(body, '\"') AS a, instr(body, 'k') AS b, contains(body, 'k') AS c, starts_with(body, 'e') AS s, ends_with(body, '}') AS e, position('r' in body) AS p FROM logs", "SELECT body, CAST(strpos(body, '\"') AS INTEGER) AS a, CAST(strpos(body, 'k') AS INTEGER) AS b, contains(body, 'k') AS c, starts_with(body, 'e') AS s, ends_with(body, '}') AS e, CAST(position('r' in body) AS INTEGER) AS p FROM logs"),
    "sql_string_pad": ("SELECT body, lpad(severity_text, 8, '*') AS l, rpad(severity_text, 8, '*') AS r, repeat(severity_text, 2) AS p, btrim(concat('  ', severity_text, ' ')) AS t, concat_ws('-', severity_text, body) AS w, translate(body, 'er', 'ER') AS x, replace(body, 'r', 'rr') AS y, chr(65) AS z FROM logs", "SELECT body, lpad(severity_text, 8, '*') AS l, rpad(severity_text, 8, '*') AS r, repeat(severity_text, 2) AS p, trim(concat('  ', severity_text, ' ')) AS t, concat_ws('-', severity_text, body) AS w, translate(body, 'er', 'ER') AS x, replace(body, 'r', 'rr') AS y, chr(65) AS z FROM logs"),
    "sql_concat_null": ("SELECT ts_ns, concat_skip(body, span_id) AS c FROM logs", "SELECT ts_ns, concat(body, span_id) AS c FROM logs"),
    "sql_levenshtein": ("SELECT severity_text, levenshtein(severity_text, 'ERRORS') AS d, find_in_set(severity_text, 'INFO,ERROR') AS f FROM logs", "SELECT severity_text, CAST(levenshtein(severity_text, 'ERRORS') AS INTEGER) AS d, CASE severity_text WHEN 'INFO' THEN 1 ELSE 2 END AS f FROM logs"),
    "sql_regexp": ("SELECT body, regexp_like(body, '[0-9]{2}') AS m, regexp_count(body, '[a-z]') AS c, regexp_replace_first(body, '[0-9]+', 'N') AS r, regexp_match_groups(body, '[0-9]+')[0] AS g FROM logs", "SELECT body, regexp_matches(body, '[0-9]{2}') AS m, CAST(len(regexp_extract_all(body, '[a-z]')) AS INTEGER) AS c, regexp_replace(body, '[0-9]+', 'N') AS r, regexp_extract(body, '[0-9]+') AS g FROM logs"),
    "sql_encode": ("SELECT body, lower(hex(body)) AS h, base64(cast(body as binary)) AS b FROM logs", "SELECT body, lower(hex(body)) AS h, base64(encode(body)) AS b FROM logs"),
    "sql_struct": ("SELECT ts_ns, named_struct('a', value, 'b', ts_ns).a AS a, struct(value, 1).c0 AS c, row(ts_ns, value).c1 AS r, get_field(named_struct('z', value), 'z') AS g FROM samples", "SELECT ts_ns, value AS a, value AS c, value AS r, value AS g FROM samples"),
    "sql_date_bin_interval": ("SELECT cast(date_bin(INTERVAL '15' MINUTE, ts) as string) AS bin, cast(date_bin(INTERVAL '1' DAY, ts, timestamp_ntz'2024-01-01 06:00:00') as string) AS shifted, count(*) AS n FROM logs GROUP BY 1, 2", "SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS bin, strftime(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01 06:00:00'), '%Y-%m-%d %H:%M:%S') AS shifted, count(*) AS n FROM logs GROUP BY 1, 2"),
    "sql_trunc_names": ("SELECT ts_ns, trunc(value - 60, 1) AS t1, trunc(value) AS t, ceil(value) AS c, floor(value - 60) AS f FROM samples", "SELECT ts_ns, sign(value - 60) * floor(abs(value - 60) * 10) / 10 AS t1, trunc(value) AS t, ceil(value) AS c, floor(value - 60) AS f FROM samples"),
    "sql_log_names": ("SELECT ts_ns, round(ln(value - 50), 6) AS l, round(log10(value), 6) AS d, round(log(value), 6) AS g, round(log(2, value), 6) AS b, round(log2(value), 6) AS t, isnan(ln(-value)) AS n FROM samples WHERE value > 50", "SELECT ts_ns, round(ln(value - 50), 6) AS l, round(log10(value), 6) AS d, round(log10(value), 6) AS g, round(log2(value), 6) AS b, round(log2(value), 6) AS t, true AS n FROM samples WHERE value > 50"),
    "sql_concat": ("SELECT ts_ns, concat(body, span_id, '!') AS c FROM logs", "SELECT ts_ns, body || '!' AS c FROM logs"),
    "sql_regexp_names": ("SELECT body, regexp_replace(body, '[0-9]', 'N') AS r, regexp_replace(body, '[0-9]', 'N', 'g') AS g, regexp_match(body, '([a-z]+) .*?([0-9]+)')[1] AS m, regexp_match(body, '[0-9]+')[0] AS w, regexp_match(body, 'nowhere') IS NULL AS z, regexp_instr(body, '[0-9]') AS p FROM logs", "SELECT body, regexp_replace(body, '[0-9]', 'N') AS r, regexp_replace(body, '[0-9]', 'N', 'g') AS g, regexp_extract(body, '([a-z]+) .*?([0-9]+)', 2) AS m, regexp_extract(body, '[0-9]+') AS w, true AS z, CAST(strpos(body, regexp_extract(body, '[0-9]')) AS INTEGER) AS p FROM logs"),
    "sql_from_unixtime": ("SELECT ts_ns, cast(from_unixtime(ts_ns div 1000000000) as string) AS t, cast(to_local_time(ts) as date) AS d FROM logs", "SELECT ts_ns, strftime(make_timestamp(ts_ns // 1000000000 * 1000000), '%Y-%m-%d %H:%M:%S') AS t, CAST(ts AS DATE) AS d FROM logs"),
    "sql_to_char": ("SELECT ts_ns, to_char(ts, '%Y-%m-%d at %H:%M:%S') AS t, date_format(ts, '%d/%m/%y %j') AS d FROM logs", "SELECT ts_ns, strftime(ts, '%Y-%m-%d at %H:%M:%S') AS t, strftime(ts, '%d/%m/%y %j') AS d FROM logs"),
    "sql_encode_names": ("SELECT body, encode(body, 'hex') AS h, encode(body, 'base64') AS b, cast(decode(encode(body, 'hex'), 'hex') as string) AS u, cast(decode(encode(body, 'base64'), 'base64') as string) AS v FROM logs", "SELECT body, lower(hex(body)) AS h, rtrim(base64(encode(body)), '=') AS b, body AS u, body AS v FROM logs"),
    "sql_arrow_names": ("SELECT ts_ns, arrow_typeof(value) AS a, arrow_typeof(ts_ns) AS b, arrow_typeof(cast(value as string)) AS c, arrow_cast(ts_ns, 'Utf8') AS d, arrow_try_cast('x', 'Int64') AS e, cast_to_type('12', 1) AS f, try_cast_to_type('x1', 1) AS g FROM samples", "SELECT ts_ns, 'Float64' AS a, 'Int64' AS b, 'Utf8' AS c, CAST(ts_ns AS VARCHAR) AS d, CAST(NULL AS BIGINT) AS e, 12 AS f, CAST(NULL AS INTEGER) AS g FROM samples"),
    "sql_more_trigonometry": "SELECT ts_ns, round(acos(value / 1e6), 9) AS a, round(asin(value / 1e6), 9) AS b, round(acosh(value + 1), 6) AS c, round(atanh(value / 1e6), 9) AS d, round(tan(value / 1000), 6) AS t FROM samples",
    "sql_more_numbers": ("SELECT ts_ns, pow(value, 2) AS p, signum(value - 50) AS s, isnan(value) AS n, nanvl(value, 0) AS v FROM samples", "SELECT ts_ns, value ** 2 AS p, CAST(sign(value - 50) AS DOUBLE) AS s, isnan(value) AS n, value AS v FROM samples"),
    "sql_more_strings": ("SELECT body, character_length(body) AS n, ltrim(concat('  ', severity_text, ' ')) AS l, rtrim(concat(' ', severity_text, '  ')) AS r, substring(body, 2, 4) AS s, substr_index(body, ' ', 1) AS i FROM logs", "SELECT body, CAST(length(body) AS INTEGER) AS n, severity_text || ' ' AS l, ' ' || severity_text AS r, substring(body, 2, 4) AS s, split_part(body, ' ', 1) AS i FROM logs"),
    "sql_more_times": ("SELECT ts_ns, cast(datepart('hour', ts) as bigint) AS h, cast(datetrunc('day', ts) as date) AS d, make_date(2024, 2, cast(k % 28 + 1 as int)) AS m, cast(make_time(cast(k % 24 as int), 5, 6) as string) AS t, cast(to_time('04:05:06') as string) AS u FROM logs", "SELECT ts_ns, date_part('hour', ts) AS h, CAST(date_trunc('day', ts) AS DATE) AS d, make_date(2024, 2, CAST(k % 28 + 1 AS INTEGER)) AS m, lpad(CAST(k % 24 AS VARCHAR), 2, '0') || ':05:06' AS t, '04:05:06' AS u FROM logs"),
    "sql_to_timestamp": ("SELECT ts_ns, date_format(to_timestamp(cast(ts as string)), '%Y-%m-%d %H:%M:%S.%f') AS a, date_format(to_timestamp_micros(ts_ns div 1000), '%Y-%m-%d %H:%M:%S.%f') AS b, date_format(to_timestamp_millis(ts_ns div 1000000), '%Y-%m-%d %H:%M:%S') AS c, date_format(to_timestamp_nanos(ts_ns), '%Y-%m-%d %H:%M:%S.%f') AS d, date_format(to_timestamp_seconds(ts_ns div 1000000000), '%Y-%m-%d %H:%M:%S') AS e FROM logs", "SELECT ts_ns, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS a, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS b, strftime(ts, '%Y-%m-%d %H:%M:%S') AS c, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS d, strftime(ts, '%Y-%m-%d %H:%M:%S') AS e FROM logs"),
    "sql_cube": "SELECT label(labels, 'event_type') AS event_type, label(labels, 'shard') AS shard, count(*) AS n FROM samples GROUP BY CUBE (1, 2)",
    "sql_grouping_sets": "SELECT label(labels, 'event_type') AS event_type, label(labels, 'shard') AS shard, count(*) AS n FROM samples GROUP BY GROUPING SETS ((label(labels, 'event_type')), (label(labels, 'shard')), ())",
    "sql_intersect_all": "SELECT label(labels, 'event_type') AS x FROM samples WHERE value > 100 INTERSECT ALL SELECT label(labels, 'event_type') AS x FROM samples WHERE value < 50",
    "sql_except_all": "SELECT label(labels, 'shard') AS x FROM samples WHERE value > 20 EXCEPT ALL SELECT label(labels, 'shard') AS x FROM samples WHERE value > 100",
    "sql_cast": ("SELECT ts_ns, cast(value as bigint) AS i, cast(k as string) AS s, try_cast(body as double) AS t FROM (SELECT ts_ns, k + 0.25D AS value, k, body FROM logs)", "SELECT ts_ns, CAST(floor(k + 0.25) AS BIGINT) AS i, CAST(k AS VARCHAR) AS s, TRY_CAST(body AS DOUBLE) AS t FROM logs"),
    "logs_has_word": ("SELECT doc_id FROM logs_text WHERE has_word(body, 'the')", f"SELECT doc_id FROM logs_text WHERE contains(' ' || {_WORDS} || ' ', ' the ')"),
    "logs_has_phrase": ("SELECT doc_id FROM logs_text WHERE has_word(body, 'The, and')", f"SELECT doc_id FROM logs_text WHERE contains(' ' || {_WORDS} || ' ', ' the and ')"),
    "logs_attrs_eq": "SELECT ts_ns, body FROM logs WHERE attrs['event_type'] = 'purchase'",
    "logs_attrs_missing": ("SELECT count(*) AS n FROM logs WHERE attrs['nothing'] IS NULL", "SELECT count(*) AS n FROM logs"),
    "logs_declared_cmp": "SELECT ts_ns, k FROM logs WHERE k > 90",
    "logs_declared_sum": "SELECT attrs['event_type'] AS event_type, cast(sum(k) as bigint) AS s, max(k) AS m FROM logs GROUP BY 1",
    "logs_severity_rollup": ("SELECT severity_text, cast(to_date(ts) as string) AS day, count(*) AS n FROM logs WHERE severity_num >= 9 GROUP BY 1, 2", "SELECT severity_text, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM logs WHERE severity_num >= 9 GROUP BY 1, 2"),
    "logs_ts_range": "SELECT ts_ns, severity_text FROM logs WHERE ts_ns >= 1704672000000000000 AND ts_ns < 1704758400000000000",
    "alerts_by_rule": "SELECT rule_id, state, count(*) AS n, max(generation) AS g, max(ts_ns) AS newest FROM alerts GROUP BY rule_id, state",
    "alerts_scan": ("SELECT ts_ns, alert_id, state, attrs['annotation.summary'] AS summary FROM alerts WHERE rule_id = 'errors-1' AND ts_ns >= 1704672000000000000", "SELECT ts_ns, alert_id, state, 'errors of ' || usr AS summary FROM alerts WHERE rule_id = 'errors-1' AND ts_ns >= 1704672000000000000"),
    "alerts_latest_state": "SELECT alert_id, state, ts_ns FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY ts_ns DESC, state) AS r FROM alerts) t WHERE r = 1",
    "audit_scan": ("SELECT ts_ns, severity_text, body, attrs['hold.scope'] AS scope FROM audit WHERE attrs['kind'] = 'legal_hold' AND attrs['hold.op'] = 'put'", "SELECT ts_ns, severity_text, 'legal hold ' || op AS body, scope FROM audit WHERE op = 'put'"),
    "audit_open_holds": ("SELECT attrs['hold.scope'] AS scope, count(*) FILTER (WHERE attrs['hold.op'] = 'put') AS put, count(*) AS n FROM audit GROUP BY 1", "SELECT scope, count(*) FILTER (WHERE op = 'put') AS put, count(*) AS n FROM audit GROUP BY 1"),
    "spans_trace_lookup": "SELECT span_id, parent_span_id, name, duration_ns FROM spans WHERE trace_id = md5('5979')",
    "spans_window_overlap": ("SELECT count(*) AS n FROM spans WHERE start_ts <= timestamp_ntz'1996-06-01 00:00:00' AND end_ts >= timestamp_ntz'1996-05-01 00:00:00'", "SELECT count(*) AS n FROM spans WHERE start_ts <= TIMESTAMP '1996-06-01 00:00:00' AND end_ts >= TIMESTAMP '1996-05-01 00:00:00'"),
    "spans_duration_range": "SELECT name, count(*) AS n, max(duration_ns) AS longest FROM spans WHERE duration_ns > 86400000000000 GROUP BY name",
    "spans_status_or": "SELECT cast(status_code as int) AS status_code, count(*) AS n FROM spans WHERE status_code = 2 OR status_code = 1 GROUP BY status_code",
    "spans_service_slowest": "SELECT service_name, span_id, trace_id, duration_ns FROM (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY duration_ns DESC, trace_id, span_id, name) AS r FROM spans) t WHERE r <= 5",
    "spans_roots": "SELECT service_name, count(*) AS n FROM spans WHERE parent_span_id IS NULL GROUP BY service_name",
}


def _for_oracle(text: str) -> str:
    return re.sub(r"(?:label\(labels, |attrs\[)'(\w+)'[)\]]", r"\1", text)


def _runner(text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, text)

    return query


def queries() -> dict:
    """All queries by name."""
    return {name: _runner(q if isinstance(q, str) else q[0]) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by name."""
    found = {}
    for name, q in QUERIES.items():
        text = _for_oracle(q) if isinstance(q, str) else q[1]
        table = next(t for t in ("logs_text", "samples", "logs", "spans", "alerts", "audit") if re.search(rf"\b{t}\b", text))
        found[name] = f"WITH {_CTES[table]}, {text[5:]}" if text.startswith("WITH ") else f"WITH {_CTES[table]} {text}"
    return found
