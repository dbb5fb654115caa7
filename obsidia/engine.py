"""The public surface: PromQL, discovery, SQL and analytics over one directory of tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsidia.errors import AnalyticsError, EmptySeries
from obsidia.functions import labels as L
from obsidia.operators import evaluate
from obsidia.operators.grid import Grid
from obsidia.plans import ast
from obsidia.plans.parser import duration_ns, parse
from obsidia.sources import views
from obsidia.sources.series import SeriesSource


#: Series that one analysis takes.
MAX_SERIES = 1000


@dataclass
class Engine:
    """Queries over one source; times are nanoseconds since the epoch."""

    spark: SparkSession
    source: SeriesSource
    sf_dir: str | None = None

    @staticmethod
    def open(spark: SparkSession, sf_dir: str) -> Engine:
        return Engine(spark, views.metrics(spark, sf_dir), sf_dir)

    def promql(self, query: str, time: int, lookback: str = "5m") -> DataFrame:
        """``labels, ts_ns, value`` at one time; a bare range selector gives its raw samples."""
        grid = Grid.instant(time)
        tree = parse(query)
        e = evaluate.Evaluator(self.spark, self.source, grid, duration_ns(lookback))
        if isinstance(tree, ast.Subquery) or (isinstance(tree, ast.Selector) and tree.range_ns is not None):
            windows, _, _ = e.windows(tree, grid, False)
            return windows.select(F.col("sig").alias("labels"), "ts_ns", "value")
        return evaluate.as_frame(self.spark, e.eval(tree, grid), grid)

    def promql_range(self, query: str, start: int, end: int, step: int, lookback: str = "5m") -> DataFrame:
        """``labels, ts_ns, value`` at every step."""
        grid = Grid.range(start, end, step)
        return evaluate.as_frame(self.spark, evaluate.run(self.spark, self.source, query, grid, duration_ns(lookback)), grid)

    def _matching(self, match: list[str], start: int, end: int) -> DataFrame:
        parts = []
        for text in match:
            tree = parse(text)
            if not isinstance(tree, ast.Selector):
                raise evaluate.Parse("match[] takes selectors")
            parts.append(self.source.samples(tree.matchers, start, end))
        found = reduce(DataFrame.unionByName, parts)
        return found.where((F.col("ts_ns") >= start) & (F.col("ts_ns") <= end)).select("sig").distinct()

    def series(self, match: list[str], start: int, end: int) -> DataFrame:
        """Label sets of series that match any selector and have samples in the window."""
        return self._matching(match, start, end).select(F.col("sig").alias("labels"))

    def label_names(self, match: list[str], start: int, end: int) -> DataFrame:
        """Names of their labels."""
        return self._matching(match, start, end).select(F.explode(F.map_keys(L.map_of(F.col("sig")))).alias("name")).distinct().orderBy("name")

    def label_values(self, name: str, match: list[str], start: int, end: int) -> DataFrame:
        """Values of one label."""
        return self._matching(match, start, end).select(L.map_of(F.col("sig"))[name].alias("value")).where("value is not null").distinct().orderBy("value")

    def metadata(self, metric: str | None = None, limit: int | None = None) -> DataFrame:
        """Type, help and unit by metric."""
        m = views.metadata(self.spark)
        m = (m.where(F.col("metric") == metric) if metric else m).orderBy("metric")
        return m if limit is None else m.limit(limit)

    def exemplars(self, query: str, start: int, end: int) -> DataFrame:
        """Exemplars of the series that a query's selectors name, in a closed window; offsets and ``@`` do not count."""
        e = views.exemplars(self.spark, self.sf_dir)
        picked = None
        for s in selectors(parse(query)):
            cond = F.lit(True)
            labels = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("shard"), F.col("shard"))
            for m in s.matchers:
                if m.name != "__name__":
                    cond = cond & L.matches(labels, m.name, m.op, m.value)
            picked = cond if picked is None else picked | cond
        return e.where(picked & F.col("ts_ns").between(start, end))

    def sql(self, text: str, strict: bool = True, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """A read-only query over one signal table; ``tables`` take the place of the engine's own by name."""
        from obsidia.sql.engine import run

        return run(self.spark, self.sf_dir, text, strict, tables)

    def analytics(self, match: str, start: int, end: int, analysis: str = "summary", percentiles: tuple[float, ...] = (50, 95), most: int = MAX_SERIES) -> DataFrame:
        """``summary`` or ``change_point`` of each series that a selector names, over a closed window.

        No series at all, or more than ``most``, is an error.
        """
        from obsidia.analytics.change_point import change_points
        from obsidia.analytics.summary import summary

        if analysis not in ("summary", "change_point"):
            raise AnalyticsError(f"unknown analysis {analysis}")
        tree = parse(match)
        if not isinstance(tree, ast.Selector):
            raise evaluate.Parse("analytics take a selector")
        rows = self.source.samples(tree.matchers, start, end).where(~F.col("stale") & F.col("ts_ns").between(start, end)).select(F.col("sig").alias("labels"), "ts_ns", "value")
        found = rows.select("labels").distinct().limit(most + 1).count()
        if found == 0:
            raise EmptySeries("no series")
        if found > most:
            raise AnalyticsError(f"more than {most} series")
        return summary(rows, ["labels"], percentiles=percentiles) if analysis == "summary" else change_points(rows, "labels")


def selectors(e: ast.Expr) -> list[ast.Selector]:
    """All selectors of a tree."""
    if isinstance(e, ast.Selector):
        return [e]
    inner = [getattr(e, c, None) for c in ("expr", "left", "right", "param")] + list(getattr(e, "args", []))
    return [s for x in inner if isinstance(x, ast.Expr) for s in selectors(x)]
