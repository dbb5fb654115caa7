"""Label sets: a canonical JSON string is the identity of a series, and the map is read from it where it is needed.

Maps can be neither join keys nor window partitions, so vectors carry the string alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,string>"


def sig_of(labels: Column) -> Column:
    """Canonical string of a label map: keys in order, empty values left out (absent equals empty)."""
    kept = F.map_filter(labels, lambda k, v: v.isNotNull() & (v != ""))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def map_of(sig: Column) -> Column:
    """Label map of a canonical string."""
    return F.from_json(sig, MAP)


def label(sig: Column, name: str) -> Column:
    """A label's value, empty if absent."""
    return F.coalesce(map_of(sig)[name], F.lit(""))


def keep(sig: Column, names: list[str]) -> Column:
    """Only the named labels."""
    return F.lit("{}") if not names else sig_of(F.map_filter(map_of(sig), lambda k, v: k.isin(names)))


def drop(sig: Column, names: list[str]) -> Column:
    """All but the named labels."""
    return sig_of(F.map_filter(map_of(sig), lambda k, v: ~k.isin(names)))


def drop_name(sig: Column) -> Column:
    """Without the metric name."""
    return drop(sig, ["__name__"])


def matches(labels: Column, name: str, op: str, value: str) -> Column:
    """Condition of one matcher on a label map; patterns are anchored."""
    have = F.coalesce(labels[name], F.lit(""))
    if op in ("=", "!="):
        # without the empty case the plain comparison is what a scan can use
        return have != value if op == "!=" else labels[name] == value if value else have == value
    if op == "=~" and re.fullmatch(r"[\w\- ]+(\|[\w\- ]+)*", value):
        return labels[name].isin(value.split("|"))
    if op == "=~" and (m := re.fullmatch(r"([\w\- ]+)\.\*", value)):
        return labels[name].startswith(m[1])
    found = have.rlike(f"^(?s:{value})$")
    return found if op == "=~" else ~found
