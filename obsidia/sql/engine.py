"""SQL queries over the signal views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from obsidia.errors import SqlParse
from obsidia.sources import views
from obsidia.sql.functions import register
from obsidia.sql.names import rewritten
from obsidia.sql.validate import validate

VIEWS = {"samples": views.samples, "logs": views.logs, "spans": views.spans, "logs_text": views.logs_text, "alerts": views.alerts, "audit": views.audit}
_registered: set[int] = set()


def run(spark: SparkSession, sf_dir: str, text: str, strict: bool = True, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Validate, bind the one table that the query reads (one of ``tables`` first), and plan it."""
    signal = validate(text, strict)
    if id(spark) not in _registered:
        register(spark)
        _registered.add(id(spark))
    if tables and signal in tables:
        tables[signal].createOrReplaceTempView(signal)
    elif signal is not None:
        VIEWS[signal](spark, sf_dir).createOrReplaceTempView(signal)
    try:
        return spark.sql(rewritten(text))
    except Exception as e:  # the parser's own class carries no code worth keeping
        if "PARSE_SYNTAX_ERROR" in str(e):
            raise SqlParse(str(e).splitlines()[0]) from None
        raise
