"""A spread of registered queries against DuckDB on the smallest tables."""

import math
import os

import pytest

from obsidia import queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
FOUND, ORACLE = queries.queries(), queries.oracle_sql()
#: Functions whose names mean something else in Spark, and a spread of the rest.
NAMED = [n for n in sorted(FOUND) if n.endswith("_names") or n.startswith(("sql_more_", "ingest_", "alerts_", "audit_"))]
CHOSEN = sorted({*sorted(FOUND)[::9], *NAMED})


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_every_query_has_an_oracle():
    assert set(FOUND) - set(ORACLE) == {"analytics_change_point"}


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows(spark, con, name):
    if name not in ORACLE:
        pytest.skip("rows only")
    df = FOUND[name](spark, SF)
    cur = con.execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    want = sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in cur.fetchall())
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert sorted(df.columns) == sorted(names) and got == want
