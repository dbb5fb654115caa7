"""The read-only gate of the SQL surface: one query over one signal table, from admitted functions."""

from __future__ import annotations

import re

from obsidia.errors import CrossSignalQuery, Empty, ExcludedAggregate, ExcludedScalar, ExcludedWindow, MultipleStatements, NotReadOnly, SqlParse, WriteInQuery

SIGNALS = ("samples", "logs", "spans", "alerts", "audit", "logs_text")
AGGREGATES = {"count", "sum", "min", "max", "avg", "mean"}
EXCLUDED_AGGREGATES = set(
    "approx_distinct approx_median approx_percentile_cont approx_percentile_cont_with_weight array_agg bit_and bit_or bit_xor bool_and bool_or corr covar covar_pop covar_samp grouping median percentile_cont quantile_cont regr_avgx regr_avgy regr_count "
    "regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy stddev stddev_pop stddev_samp string_agg var var_pop var_population var_samp var_sample".split()
)
EXCLUDED_WINDOWS = {"first_value", "last_value", "nth_value"}
EXCLUDED_SCALARS = {"uuid", "random", "rand", "now", "current_timestamp", "current_date", "current_time", "version", "today"}
_WRITES = {"insert", "update", "delete", "merge", "drop", "create", "alter", "truncate", "copy"}
_LEADS = {"select", "with", "values", "table"}


def stripped(text: str) -> str:
    """The statement with comments gone and the insides of quotes blanked."""
    out, i = [], 0
    while i < len(text):
        two, c = text[i : i + 2], text[i]
        if two == "--":
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif two == "/*":
            end = text.find("*/", i + 2)
            if end < 0:
                raise SqlParse("unterminated comment")
            i, c = end + 2, " "
            out.append(" ")
        elif c in "'\"`":
            end = i + 1
            while True:
                end = text.find(c, end)
                if end < 0:
                    raise SqlParse("unterminated quote")
                if text[end : end + 2] != c * 2:
                    break
                end += 2
            inner = text[i + 1 : end]
            out.append(c + (re.sub(r"[^\w]", "_", inner) if c != "'" else "") + c)
            i = end + 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


def validate(text: str, strict: bool = True) -> str | None:
    """Raise unless the text is an admitted query; the signal table that it reads, if any."""
    plain = stripped(text)
    parts = [p for p in plain.split(";") if p.strip()]
    if not parts:
        raise Empty("no statement")
    if len(parts) > 1:
        raise MultipleStatements(f"{len(parts)} statements")
    words = re.findall(r"[A-Za-z_][A-Za-z0-9_]*", re.sub(r"'[^']*'", "''", parts[0]).lower())
    lead = parts[0].lstrip().lstrip("(").lstrip()[:1]
    if not words or not (words[0] in _LEADS) or not lead.isalpha():
        raise NotReadOnly(f"only queries are admitted, not {words[0].upper() if words else lead!r}")
    body = parts[0].lower()
    if any(re.search(rf"(?:^|\(|\bas\s*\(|\))\s*{w}\s+(?:into|from|table|view|[a-z_]+\s+set)\b", body) for w in _WRITES):
        raise WriteInQuery("a write is nested in the query")
    calls = {m[1] for m in re.finditer(r"([a-z_][a-z0-9_]*)\s*\(", body)}
    windowed = {m[1] for m in re.finditer(r"([a-z_][a-z0-9_]*)\s*\((?:[^()]|\([^()]*\))*\)\s*(?:ignore nulls|respect nulls)?\s*over\b", body)}
    if strict:
        for name in sorted(calls):
            if name in EXCLUDED_WINDOWS:
                raise (ExcludedWindow if name in windowed else ExcludedAggregate)(name)
            if name in EXCLUDED_AGGREGATES:
                raise ExcludedAggregate(name)
        for name in sorted(EXCLUDED_SCALARS):
            if name in calls or (name.startswith("current_") and name in words):
                raise ExcludedScalar(name)
        if "avg" in windowed and re.search(r"\bavg\s*\([^()]*\)\s*over\s*\([^()]*\b(?:rows|range)\s+between\s+(?!unbounded)", body):
            raise ExcludedWindow("avg over a moving frame")
    named = set(re.findall(r"\b([a-z_][a-z0-9_]*)\s+as\s*\(", body)) if words[0] == "with" else set()
    read = {m[1] for m in re.finditer(r"\b(?:from|join|,)\s+([a-z_][a-z0-9_]*)", body) if m[1] in SIGNALS and m[1] not in named}
    if len(read) > 1:
        raise CrossSignalQuery(", ".join(sorted(read)))
    return next(iter(read), None)
