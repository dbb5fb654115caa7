"""Registry of the engine's queries and their oracles."""

from __future__ import annotations

from obsidia.queries import misc, promql, sql


def queries() -> dict:
    """Every query of the engine by name."""
    return {**promql.queries(), **sql.queries(), **misc.queries()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {**promql.oracle_sql(), **sql.oracle_sql(), **misc.oracle_sql()}
