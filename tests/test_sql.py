import pytest

from obsidia import errors
from obsidia.sql.validate import EXCLUDED_AGGREGATES, validate


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("", errors.Empty), (" ; ", errors.Empty), ("select 1; select 2", errors.MultipleStatements), ("drop table samples", errors.NotReadOnly), ("insert into samples values (1)", errors.NotReadOnly), ("explain select 1", errors.NotReadOnly), ("set a = 1", errors.NotReadOnly),
        ("with x as (delete from samples) select 1", errors.WriteInQuery), ("select median(value) from samples", errors.ExcludedAggregate), ("select first_value(value) over (order by ts_ns) from samples", errors.ExcludedWindow), ("select now()", errors.ExcludedScalar), ("select current_date", errors.ExcludedScalar),
        ("select * from samples join logs on true", errors.CrossSignalQuery), ("select avg(value) over (order by ts_ns rows between 1 preceding and current row) from samples", errors.ExcludedWindow),
    ],
)
def test_rejected(text, error):
    with pytest.raises(error):
        validate(text)


@pytest.mark.parametrize("name", sorted(EXCLUDED_AGGREGATES))
def test_every_excluded_aggregate(name):
    with pytest.raises(errors.ExcludedAggregate):
        validate(f"select {name}(value) from samples")
    assert validate(f"select {name}(value) from samples", strict=False) == "samples"


def test_admitted():
    assert validate("select 'drop table x; now()' as t, \"insert\" from samples -- ; comment") == "samples"
    assert validate("with logs as (select * from samples) select count(*) from logs") == "samples"
    assert validate("select 1") is None


def test_scalar_functions(spark):
    from obsidia.sql.functions import register

    register(spark)
    row = spark.sql(
        "select has_word('Connection timeout!', 'TIMEOUT') a, has_word('connection timeout', 'time') b, has_word(null, 'x') c, has_word('x', '') d, gcd(12L, -18L) e, lcm(4L, 6L) f, label_match(map('a', 'xy'), 'a', 'x') g,"
        " label_match(map('a', 'xy'), 'b', '') h, regexp_replace_first('foo123bar45', '[0-9]+', 'X') i, truncate_to(-1.29, 1) j, label(map('a', '1'), 'b') k"
    ).first()
    assert tuple(row) == (True, False, False, True, 6, 12, False, True, "fooXbar45", -1.2, None)


def both(spark, name, values):
    """The query's rows over such values and its SQL's, as text: signs of zero count."""
    from obsidia.queries.sql import QUERIES
    from obsidia.sql.engine import run

    con = pytest.importorskip("duckdb").connect()
    con.execute("CREATE TABLE samples (ts_ns BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO samples VALUES (?, ?)", list(enumerate(values)))
    df = spark.createDataFrame(list(enumerate(values)), "ts_ns bigint, value double")
    return [sorted(map(str, rows)) for rows in (map(tuple, run(spark, "", QUERIES[name], tables={"samples": df}).collect()), con.execute(QUERIES[name]).fetchall())]


def test_math_is_rounded_as_in_sql(spark):
    got, want = both(spark, "sql_math", [1571.39, 1923.26, 1947.45, 1992.28, 71000.0, 2.5, 0.0, -0.5, -2.5, float("nan"), float("inf"), None])
    assert got == want


def test_round(spark):
    from obsidia.sql.engine import run

    df = spark.createDataFrame([(1, 1.25), (1, 2.0)], "ts_ns bigint, value double")
    row = run(
        spark, "", "select round(0.49999999999999994D) a, round(-2.5D) b, round(1549, -2) c, round(1e306D, 4) d, round(-0.0003D, 3) e, round((select max(value) from samples), 1) f, round(sum(value), 1) g, round(1, null) h from samples group by ts_ns having round(sum(value)) = 3 order by round(g)", tables={"samples": df}
    ).first()
    assert list(map(str, row)) == ["0.0", "-3.0", "1500.0", "1e+306", "-0.0", "2.0", "3.3", "None"]


def test_trigonometry_keeps_the_sign_of_zero(spark):
    got, want = both(spark, "sql_trigonometry", [39.27, 117.81, 177.5, 22.0, 0.0, -1e-9, 3.141592653589793, float("nan"), None])
    assert got == want and sum("-0.0" in r for r in got) >= 3
