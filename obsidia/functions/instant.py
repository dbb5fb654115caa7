"""Elementwise PromQL functions as column expressions, with IEEE rules where Spark differs.

Spark's logarithms give null below zero, its division by zero raises and NaN counts as greatest; each is guarded here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = math.nan, math.inf


def divide(a: Column, b: Column) -> Column:
    """IEEE division."""
    by_zero = F.when((a == 0) | F.isnan(a), NAN).otherwise(F.when((a > 0) == (F.atan2(F.lit(0.0), b) < 1), INF).otherwise(-INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def modulo(a: Column, b: Column) -> Column:
    """C's fmod: the dividend's sign, NaN for a zero divisor or infinite dividend."""
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF), NAN).otherwise(F.when(F.abs(b) == INF, a).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b)))


def _whole(f):
    return lambda v: F.when(F.isnan(v) | (F.abs(v) >= float(2**53)), v).otherwise(f(v).cast("double"))


def _log(f):
    return lambda v: F.when(v == 0, -INF).when(F.isnan(v) | (v < 0), NAN).otherwise(f(v))


ELEMENTWISE = {
    "abs": F.abs, "ceil": _whole(F.ceil), "floor": _whole(F.floor), "sqrt": F.sqrt, "exp": F.exp,
    "ln": _log(F.ln), "log2": _log(F.log2), "log10": _log(F.log10), "sgn": lambda v: F.when(F.isnan(v), v).otherwise(F.signum(v)),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "deg": F.degrees, "rad": F.radians,
}


def round_to(v: Column, to: Column) -> Column:
    """Nearest multiple of ``to``, halves up."""
    inverse = divide(F.lit(1.0), to)
    return divide(_whole(F.floor)(v * inverse + 0.5), inverse)


def clamp_min(v: Column, low: Column) -> Column:
    return F.when(F.isnan(v) | F.isnan(low), NAN).otherwise(F.greatest(v, low))


def clamp_max(v: Column, high: Column) -> Column:
    return F.when(F.isnan(v) | F.isnan(high), NAN).otherwise(F.least(v, high))


def _date(v: Column) -> Column:
    """UTC date of seconds since the epoch, whatever the session's time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(v / 86400).cast("int"))


def _clock(unit: int, turns: int):
    return lambda v: F.pmod(F.floor(v / unit), F.lit(turns))


CALENDAR = {
    "minute": _clock(60, 60), "hour": _clock(3600, 24), "day_of_week": lambda v: F.dayofweek(_date(v)) - 1,
    "day_of_month": lambda v: F.dayofmonth(_date(v)), "day_of_year": lambda v: F.dayofyear(_date(v)),
    "days_in_month": lambda v: F.dayofmonth(F.last_day(_date(v))), "month": lambda v: F.month(_date(v)), "year": lambda v: F.year(_date(v)),
}

ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "%": modulo, "^": F.pow, "atan2": F.atan2}


def _guarded(f):
    return lambda a, b: ~F.isnan(a) & ~F.isnan(b) & f(a, b)


COMPARISON = {
    "==": _guarded(lambda a, b: a == b), "!=": lambda a, b: F.isnan(a) | F.isnan(b) | (a != b),
    ">": _guarded(lambda a, b: a > b), "<": _guarded(lambda a, b: a < b), ">=": _guarded(lambda a, b: a >= b), "<=": _guarded(lambda a, b: a <= b),
}


def label_text(v: Column) -> Column:
    """A value as count_values writes it: plain digits, no trailing ``.0``."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", v), "0+$", ""), r"\.$", "")
    short = F.regexp_replace(v.cast("string"), r"\.0$", "")
    return F.when(F.isnan(v), "NaN").when(v == math.inf, "+Inf").when(v == -math.inf, "-Inf").when(v.cast("string").contains("E"), plain).otherwise(short)
