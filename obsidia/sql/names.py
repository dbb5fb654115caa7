"""Calls whose names mean something else in Spark, rewritten to expressions that give what the SQL surface promises."""

from __future__ import annotations

import re
from collections.abc import Callable

from obsidia.errors import SqlParse

_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_ARROW = {
    "boolean": "Boolean", "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "Utf8", "binary": "Binary", "date": "Date32",
    "timestamp_ntz": "Timestamp(Microsecond, None)", "timestamp": 'Timestamp(Microsecond, Some("UTC"))',
}
_SQL_TYPE = {v.lower(): k for k, v in _ARROW.items()} | {"largeutf8": "string", "utf8view": "string", "date64": "date", "timestamp(nanosecond, none)": "timestamp_ntz"}
_STRFTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy",
}


def _literal(arg: str) -> str | None:
    """The value of a plain string literal."""
    m = re.fullmatch(r"\s*'((?:[^']|'')*)'\s*", arg)
    return m and m[1].replace("''", "'")


def _pattern(arg: str) -> str:
    """A literal strftime pattern as Java's."""
    text = _literal(arg)
    if text is None:
        return arg
    out = []
    for m in re.finditer(r"%(.)|([^%]+)", text, re.DOTALL):
        if m[1] is None:
            # letters stand for themselves, other characters need no quotes
            out.append(re.sub(r"[A-Za-z]+", lambda w: f"''{w[0]}''", m[2].replace("'", "''''")))
        elif m[1] == "%":
            out.append("%")
        elif m[1] in _STRFTIME:
            out.append(_STRFTIME[m[1]])
        else:
            raise SqlParse(f"date pattern %{m[1]}")
    return "'" + "".join(out) + "'"


def _type(arg: str) -> str:
    name = (_literal(arg) or "").lower()
    if name not in _SQL_TYPE and name not in _ARROW:
        raise SqlParse(f"unknown type {arg.strip()}")
    return _SQL_TYPE.get(name, name)


def _micros(ts: str) -> str:
    return f"timestampdiff(MICROSECOND, {_EPOCH}, {ts})"


def _at(micros: str) -> str:
    return f"({_EPOCH} + make_dt_interval(0, 0, 0, cast(({micros}) / 1000000BD as decimal(18, 6))))"


def _date_bin(a: list[str]) -> str:
    origin = a[2] if len(a) > 2 else _EPOCH
    return _at(f"date_bin_us({_micros(f'{_EPOCH} + {a[0]}')}, {_micros(a[1])}, {_micros(origin)})")


def _match(a: list[str]) -> str:
    pattern = _literal(a[1])
    groups = re.compile(pattern).groups if pattern is not None else 0
    picked = ", ".join(f"regexp_extract({a[0]}, {a[1]}, {g})" for g in (range(1, groups + 1) if groups else [0]))
    return f"CASE WHEN {a[0]} rlike {a[1]} THEN array({picked}) END"


def _replace(a: list[str]) -> str:
    if len(a) > 3 and "g" in (_literal(a[3]) or ""):
        return f"regexp_replace({a[0]}, {a[1]}, {a[2]})"
    return f"regexp_replace_first({a[0]}, {a[1]}, {a[2]})"


def _log(a: list[str]) -> str:
    return f"log10_ieee({a[0]})" if len(a) == 1 else f"(ln_ieee({a[1]}) / ln_ieee({a[0]}))"


def _round(a: list[str]) -> str:
    """Half away from zero on the scaled double, the sign of zero kept; Spark's own rounds the shortest decimal. A lambda takes the argument once, but no subquery."""
    x, n = f"cast({a[0]} as double)", f"({a[1]})" if len(a) > 1 else "0"
    scale, unit = f"pow(10, {n})", f"pow(10, least(-{n}, 308))"
    whole = "CASE WHEN abs({0} - rint({0})) = 0.5D THEN {0} + signum({0}) * 0.5D ELSE rint({0}) END"

    def near(v: str) -> str:
        return (
            f"CASE WHEN {n} >= 0 AND abs({v} * {scale}) < double('Infinity') THEN ({whole.format(f'{v} * {scale}')}) / {scale}"
            f" WHEN {n} < 0 AND abs({v}) < double('Infinity') THEN ({whole.format(f'{v} / {unit}')}) * {unit} WHEN {n} IS NOT NULL THEN {v} END"
        )

    return f"({near(x)})" if re.search(r"\bselect\b", a[0], re.IGNORECASE) else f"transform(array({x}), _x -> {near('_x')})[0]"


def _typeof(a: list[str]) -> str:
    return f"CASE typeof({a[0]}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ARROW.items()) + f" ELSE typeof({a[0]}) END"


def _encode(a: list[str]) -> str:
    kind = (_literal(a[1]) or "").lower()
    raw = f"cast({a[0]} as binary)"
    return f"lower(hex({raw}))" if kind == "hex" else f"rtrim('=', base64({raw}))" if kind == "base64" else f"encode({', '.join(a)})"


def _decode(a: list[str]) -> str:
    kind = (_literal(a[1]) or "").lower() if len(a) == 2 else ""
    return f"unhex({a[0]})" if kind == "hex" else f"unbase64({a[0]})" if kind == "base64" else f"decode({', '.join(a)})"


def _fields(a: list[str]) -> str:
    return "named_struct(" + ", ".join(f"'c{i}', {x}" for i, x in enumerate(a)) + ")"


def _cast_like(a: list[str], mode: str) -> str:
    """The first argument as the second one's type, which only the planner knows: read back from a line of text."""
    quoted = f"""concat('"', replace(cast({a[0]} as string), '"', '""'), '"')"""
    return f"""from_csv({quoted}, concat('v ', typeof({a[1]})), map('mode', '{mode}', 'escape', '"')).v"""


def _as(name: str) -> Callable[[list[str]], str]:
    return lambda a: f"{name}({', '.join(a)})"


#: name: expression from the arguments' texts
CALLS: dict[str, Callable[[list[str]], str]] = {
    "concat": lambda a: f"concat_ws('', {', '.join(a)})",
    "regexp_replace": _replace,
    "regexp_match": _match,
    "trunc": lambda a: f"truncate_to({a[0]}, {a[1] if len(a) > 1 else 0})",
    "ceil": _as("ceil_double"),
    "floor": _as("floor_double"),
    "round": _round,
    "ln": _as("ln_ieee"),
    "log": _log,
    "log2": _as("log2_ieee"),
    "log10": _as("log10_ieee"),
    "date_bin": _date_bin,
    "datetrunc": _as("date_trunc"),
    "datepart": _as("date_part"),
    "from_unixtime": lambda a: _at(f"cast({a[0]} as bigint) * 1000000BD"),
    "to_local_time": lambda a: f"cast({a[0]} as timestamp_ntz)",
    "to_char": lambda a: f"date_format({a[0]}, {_pattern(a[1])})",
    "date_format": lambda a: f"date_format({a[0]}, {_pattern(a[1])})",
    "encode": _encode,
    "decode": _decode,
    "row": _fields,
    "struct": _fields,
    "get_field": lambda a: f"({a[0]})[{a[1]}]",
    "arrow_typeof": _typeof,
    "arrow_cast": lambda a: f"cast({a[0]} as {_type(a[1])})",
    "arrow_try_cast": lambda a: f"try_cast({a[0]} as {_type(a[1])})",
    "cast_to_type": lambda a: _cast_like(a, "FAILFAST"),
    "try_cast_to_type": lambda a: _cast_like(a, "PERMISSIVE"),
}


def _skip(text: str, i: int) -> int:
    """End of the quoted text or comment that starts at i, or i."""
    if text[i] in "'\"`":
        end = i + 1
        while True:
            end = text.find(text[i], end)
            if end < 0:
                raise SqlParse("unterminated quote")
            if text[end : end + 2] != text[i] * 2:
                return end + 1
            end += 2
    if text.startswith("--", i):
        return text.find("\n", i) if "\n" in text[i:] else len(text)
    if text.startswith("/*", i):
        end = text.find("*/", i + 2)
        if end < 0:
            raise SqlParse("unterminated comment")
        return end + 2
    return i


def _arguments(text: str, i: int) -> tuple[list[str], int]:
    """Texts between the parenthesis before i and the one that closes it, and where that is passed."""
    depth, begin, out = 0, i, []
    while i < len(text):
        if (end := _skip(text, i)) > i:
            i = end
            continue
        c = text[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            if depth == 0:
                return [*out, text[begin:i]] if out or text[begin:i].strip() else [], i + 1
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[begin:i])
            begin = i + 1
        i += 1
    raise SqlParse("unbalanced parentheses")


def rewritten(text: str) -> str:
    """The statement with such calls replaced, nested ones too; quoted text and comments stay as they are."""
    out, i = [], 0
    while i < len(text):
        if (end := _skip(text, i)) > i:
            out.append(text[i:end])
            i = end
            continue
        m = _IDENT.match(text, i)
        if not m:
            out.append(text[i])
            i += 1
            continue
        i = m.end()
        call = re.compile(r"\s*\(").match(text, i)
        make = CALLS.get(m[0].lower())
        if make is None or call is None or (m.start() and text[m.start() - 1] == "."):
            out.append(m[0])
            continue
        args, i = _arguments(text, call.end())
        if not args:
            raise SqlParse(f"{m[0]} takes arguments")
        out.append(make([rewritten(a).strip() for a in args]))
    return "".join(out)
