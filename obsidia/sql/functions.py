"""Scalar functions of the SQL surface that Spark lacks, as SQL functions that inline into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Lower-cased runs of letters and digits, each cut to what 64 bytes of UTF-8 hold.
_TOKENS = r"transform(filter(split(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), x -> x <> ''), x -> CASE WHEN octet_length(x) <= 64 THEN x ELSE array_max(filter(transform(sequence(16, 64), n -> substring(x, 1, n)), p -> octet_length(p) <= 64)) END)"

#: name(parameters): body
FUNCTIONS = {
    "label(m MAP<STRING, STRING>, k STRING)": "m[k]",
    "label_match(m MAP<STRING, STRING>, k STRING, re STRING)": "coalesce(m[k], '') rlike concat('^(?:', re, ')$')",
    "has_word(t STRING, q STRING)": f"coalesce(contains(concat(' ', array_join({_TOKENS.format('t')}, ' '), ' '), concat(' ', array_join({_TOKENS.format('q')}, ' '), CASE WHEN size({_TOKENS.format('q')}) = 0 THEN '' ELSE ' ' END)), false)",
    "ends_with(a STRING, b STRING)": "endswith(a, b)",
    "starts_with(a STRING, b STRING)": "startswith(a, b)",
    "strpos(a STRING, b STRING)": "instr(a, b)",
    "substr_index(a STRING, d STRING, n INT)": "substring_index(a, d, n)",
    "to_hex(x BIGINT)": "lower(hex(x))",
    "iszero(x DOUBLE)": "x = 0",
    "gcd(a BIGINT, b BIGINT)": "aggregate(sequence(1, 93), struct(abs(a) AS x, abs(b) AS y), (s, i) -> CASE WHEN s.y = 0 THEN s ELSE struct(s.y AS x, s.x % nullif(s.y, 0) AS y) END).x",
    "lcm(a BIGINT, b BIGINT)": "CASE WHEN a = 0 OR b = 0 THEN 0 ELSE abs(a div aggregate(sequence(1, 93), struct(abs(a) AS x, abs(b) AS y), (s, i) -> CASE WHEN s.y = 0 THEN s ELSE struct(s.y AS x, s.x % nullif(s.y, 0) AS y) END).x * b) END",
    "truncate_to(x DOUBLE, n INT)": "signum(x) * floor(abs(x) * pow(10, n)) / pow(10, n)",
    "date_bin_us(width BIGINT, ts_us BIGINT, origin_us BIGINT)": "origin_us + (ts_us - origin_us - pmod(ts_us - origin_us, width))",
    "datetrunc(unit STRING, ts TIMESTAMP_NTZ)": "date_trunc(unit, ts)",
    "to_timestamp_micros(x BIGINT)": "timestamp_micros(x)",
    "to_timestamp_millis(x BIGINT)": "timestamp_millis(x)",
    "to_timestamp_nanos(x BIGINT)": "timestamp_micros(x div 1000)",
    "to_timestamp_seconds(x BIGINT)": "timestamp_seconds(x)",
    "to_unixtime(x TIMESTAMP_NTZ)": "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', x)",
    "regexp_match_groups(t STRING, re STRING)": "CASE WHEN t rlike re THEN regexp_extract_all(t, re, 0) END",
    "regexp_replace_first(t STRING, re STRING, r STRING)": "regexp_replace(t, concat('(?s)^(.*?)(?:', re, ')'), concat('$1', r))",
    "concat_skip(a STRING, b STRING)": "concat_ws('', a, b)",
    "ceil_double(x DOUBLE)": "CASE WHEN isnan(x) OR x = 0 OR abs(x) >= 4503599627370496 THEN x WHEN x < 0 AND x > -1 THEN x * 0D ELSE cast(ceil(x) as double) END",
    "floor_double(x DOUBLE)": "CASE WHEN isnan(x) OR x = 0 OR abs(x) >= 4503599627370496 THEN x ELSE cast(floor(x) as double) END",
    "ln_ieee(x DOUBLE)": "CASE WHEN x > 0 THEN ln(x) WHEN x = 0 THEN double('-Infinity') WHEN x < 0 THEN double('NaN') END",
    "log2_ieee(x DOUBLE)": "CASE WHEN x > 0 THEN log2(x) WHEN x = 0 THEN double('-Infinity') WHEN x < 0 THEN double('NaN') END",
    "log10_ieee(x DOUBLE)": "CASE WHEN x > 0 THEN log10(x) WHEN x = 0 THEN double('-Infinity') WHEN x < 0 THEN double('NaN') END",
}

def register(spark: SparkSession) -> None:
    """Create the functions in the session, and admit its TIME type."""
    spark.conf.set("spark.sql.timeType.enabled", "true")
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
