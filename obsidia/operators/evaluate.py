"""PromQL compiler: a syntax tree over a grid becomes one lazy DataFrame plan."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsidia.errors import AmbiguousMatch, EvalBudgetExhausted, InvalidLabelName, Parse, Unsupported, WrongType
from obsidia.functions import instant as I
from obsidia.functions import labels as L
from obsidia.operators import histogram, native, rangefn
from obsidia.operators.grid import Grid, assign, spread
from obsidia.operators.values import Scalar, Text, Vector
from obsidia.plans import ast
from obsidia.plans.parser import parse
from obsidia.sources.series import SeriesSource

LOOKBACK = 5 * 60 * 10**9
SUBQUERY_STEP = 60 * 10**9
SUBQUERY_POINTS = 1_000_000
_LABEL = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


@dataclass
class Evaluator:
    """Compiles expressions against one source; ``start`` and ``end`` of the query are what ``@`` may name."""

    spark: SparkSession
    source: SeriesSource
    grid: Grid
    lookback: int = LOOKBACK
    subquery_points: int = 0

    def eval(self, e: ast.Expr, grid: Grid) -> Vector | Scalar | Text:
        """Value of an expression at each step of a grid."""
        match e:
            case ast.Number(value):
                return Scalar.number(value)
            case ast.String(value):
                return Text(value)
            case ast.Selector():
                if e.range_ns is not None:
                    raise WrongType("a range vector has no value at one time")
                return self.selector(e, grid)
            case ast.Subquery():
                raise WrongType("a subquery has no value at one time")
            case ast.Unary(_, inner):
                return self.negated(self.eval(inner, grid))
            case ast.Binary():
                return self.binary(e, grid)
            case ast.Aggregate():
                return self.aggregate(e, grid)
            case ast.Call():
                return self.call(e, grid)
        raise Unsupported(type(e).__name__)

    # selectors

    def _at(self, at: int | str | None) -> int | None:
        return self.grid.start if at == "start" else self.grid.end if at == "end" else at

    def selector(self, e: ast.Selector, grid: Grid) -> Vector:
        """Latest sample in the lookback window of each step; a marker there means absence."""
        at = self._at(e.at)
        if (hists := self.source.native(e.matchers)) is not None:
            found = assign(hists, grid, self.lookback, e.offset_ns, at).groupBy("k", "sig").agg(F.max_by(F.struct("hist", "stale", "ts_ns"), "ts_ns").alias("x")).where("not x.stale")
            df = found.select("k", "sig", "x.hist", F.col("x.ts_ns").alias("ots_ns"))
            return native.HistVector(spread(df, grid) if at is not None else df)
        samples = self.source.samples(e.matchers, *self.bounds(e, grid, at, self.lookback))
        found = assign(samples, grid, self.lookback, e.offset_ns, at).groupBy("k", "sig").agg(F.max_by(F.struct("value", "stale", "ts_ns"), "ts_ns").alias("x")).where("not x.stale")
        df = found.select("k", "sig", F.col("x.value").alias("value"), F.col("x.ts_ns").alias("ots_ns"))
        return Vector(spread(df, grid) if at is not None else df)

    @staticmethod
    def bounds(e: ast.Selector, grid: Grid, at: int | None, reach: int) -> tuple[int, int]:
        """Times that windows of a length can hold."""
        first, last = (grid.start, grid.end) if at is None else (at, at)
        return first - e.offset_ns - reach, last - e.offset_ns

    def windows(self, e: ast.Expr, grid: Grid, previous: bool) -> tuple[DataFrame, int, bool]:
        """Samples by step of a range selector or subquery, its range, and whether its time is pinned."""
        at = self._at(e.at) if isinstance(e, ast.Selector | ast.Subquery) else None
        if isinstance(e, ast.Selector) and e.range_ns is not None:
            samples = self.source.samples(e.matchers, *self.bounds(e, grid, at, e.range_ns)).where("not stale")
        elif isinstance(e, ast.Subquery):
            samples = self.subquery(e, grid, at)
        else:
            raise WrongType("a range vector is needed")
        if previous:
            first = (grid.start if at is None else at) - e.offset_ns - e.range_ns
            last = (grid.end if at is None else at) - e.offset_ns
            samples = rangefn.with_previous(samples.where((F.col("ts_ns") > first) & (F.col("ts_ns") <= last)))
        return assign(samples, grid, e.range_ns, e.offset_ns, at), e.range_ns, at is not None

    def subquery(self, e: ast.Subquery, grid: Grid, at: int | None) -> DataFrame:
        """Inner expression once on the union grid of all windows: multiples of the step."""
        step = e.step_ns or SUBQUERY_STEP
        first, last = ((grid.start, grid.end) if at is None else (at, at))
        low = ((first - e.offset_ns - e.range_ns) // step + 1) * step
        high = (last - e.offset_ns) // step * step
        n = max(0, (high - low) // step + 1)
        self.subquery_points += n
        if self.subquery_points > SUBQUERY_POINTS:
            raise EvalBudgetExhausted(f"subqueries evaluate more than {SUBQUERY_POINTS} points")
        inner = Grid(low, step, max(1, n))
        value = self.eval(e.expr, inner)
        if isinstance(value, native.HistVector):
            raise Unsupported("subqueries over native histograms")
        if isinstance(value, Text):
            raise WrongType("a subquery over a string")
        df = value.df if isinstance(value, Vector) else value.attach(inner.frame(self.spark).withColumn("sig", F.lit("{}")), "value")
        return df.where(F.lit(n > 0)).select("sig", inner.time(F.col("k")).alias("ts_ns"), "value")

    # functions

    def call(self, e: ast.Call, grid: Grid) -> Vector | Scalar:
        name, args = e.name, e.args
        if name in rangefn.NAMES:
            return self.range_call(name, args, grid)
        if name in I.ELEMENTWISE:
            self.arity(e, 1)
            return self.mapped(self.vector(args[0], grid), lambda v: I.ELEMENTWISE[name](v))
        if name in I.CALENDAR:
            inner = self.vector(args[0], grid) if args else Vector(self.constant(self.time(grid), grid))
            return self.mapped(inner, lambda v: F.when(F.isnan(v), v).otherwise(I.CALENDAR[name](v).cast("double")))
        method = getattr(self, f"fn_{name}", None)
        if method is None:
            raise Unsupported(f"unknown or unsupported function {name}")
        return method(e, grid)

    @staticmethod
    def arity(e: ast.Call, least: int, most: int | None = None) -> None:
        if not least <= len(e.args) <= (least if most is None else most):
            raise Parse(f"wrong number of arguments for {e.name}")

    def vector(self, e: ast.Expr, grid: Grid) -> Vector:
        value = self.eval(e, grid)
        if not isinstance(value, Vector):
            raise WrongType("an instant vector is needed")
        return value

    def scalar(self, e: ast.Expr, grid: Grid) -> Scalar:
        value = self.eval(e, grid)
        if not isinstance(value, Scalar):
            raise WrongType("a scalar is needed")
        return value

    def text(self, e: ast.Expr) -> str:
        if not isinstance(e, ast.String):
            raise WrongType("a string is needed")
        return e.value

    @staticmethod
    def mapped(v: Vector, f) -> Vector:
        return Vector(v.df.select("k", L.drop_name(F.col("sig")).alias("sig"), f(F.col("value")).alias("value"), "ots_ns"))

    def negated(self, value):
        if isinstance(value, Vector):
            return self.mapped(value, lambda v: -v)
        if isinstance(value, Text):
            raise WrongType("a string has no sign")
        if value.df is not None:
            return Scalar(df=value.df.withColumn("scalar", -F.col("scalar")))
        return Scalar(of=lambda k: -value.of(k), constant=None if value.constant is None else -value.constant)

    def finished(self, df: DataFrame, grid: Grid) -> Vector:
        return Vector(df.select("k", "sig", "value", grid.time(F.col("k")).alias("ots_ns")))

    def constant(self, s: Scalar, grid: Grid) -> DataFrame:
        df = s.attach(grid.frame(self.spark), "value")
        return df.select("k", F.lit("{}").alias("sig"), "value", grid.time(F.col("k")).alias("ots_ns"))

    def time(self, grid: Grid) -> Scalar:
        return Scalar(of=lambda k: grid.time(k) / 1e9)

    def range_call(self, name: str, args: list[ast.Expr], grid: Grid) -> Vector:
        place = rangefn.RANGE_ARG.get(name, 0)
        wanted = 2 if name in ("quantile_over_time", "predict_linear") else 1
        if len(args) != wanted:
            raise Parse(f"wrong number of arguments for {name}")
        param = None
        if wanted == 2:
            param = self.scalar(args[1 - place], grid).constant
            if param is None:
                raise Unsupported(f"{name} takes a constant here")
        e = args[place]
        if isinstance(e, ast.Selector) and (hists := self.source.native(e.matchers)) is not None:
            if name not in ("rate", "increase", "delta") or e.range_ns is None:
                raise Unsupported(f"{name} over native histograms")
            at = self._at(e.at)
            windows = assign(hists.where("not stale"), grid, e.range_ns, e.offset_ns, at)
            df = native.rate(windows, e.range_ns, name != "delta", name == "rate").select("k", L.drop_name(F.col("sig")).alias("sig"), "hist", grid.time(F.col("k")).alias("ots_ns"))
            return native.HistVector(spread(df, grid) if at is not None else df)
        windows, range_ns, pinned = self.windows(e, grid, name in rangefn.WITH_PREVIOUS)
        df = rangefn.apply(name, windows, range_ns, param)
        if name != "last_over_time":
            df = df.withColumn("sig", L.drop_name(F.col("sig")))
        return self.finished(spread(df, grid) if pinned else df, grid)

    def fn_absent_over_time(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 1)
        windows, _, pinned = self.windows(e.args[0], grid, False)
        there = (spread(windows.select("k").distinct(), grid) if pinned else windows.select("k")).distinct()
        labels = self.equal_labels(e.args[0].matchers, True) if isinstance(e.args[0], ast.Selector) else {}
        return self.absent(there, labels, grid)

    def fn_absent(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 1)
        labels = self.equal_labels(e.args[0].matchers, False) if isinstance(e.args[0], ast.Selector) else {}
        return self.absent(self.vector(e.args[0], grid).df.select("k").distinct(), labels, grid)

    @staticmethod
    def equal_labels(matchers: list[ast.Matcher], empty_too: bool) -> dict[str, str]:
        """Labels of equality matchers; a name matched twice is left out."""
        names = [m.name for m in matchers]
        return {m.name: m.value for m in matchers if m.op == "=" and m.name != "__name__" and names.count(m.name) == 1 and m.value}

    def absent(self, there: DataFrame, labels: dict[str, str], grid: Grid) -> Vector:
        pairs = [F.lit(x) for item in sorted(labels.items()) for x in item]
        sig = F.to_json(F.create_map(*pairs)) if pairs else F.lit("{}")
        missing = grid.frame(self.spark).join(there, "k", "left_anti")
        return self.finished(missing.select("k", sig.alias("sig"), F.lit(1.0).alias("value")), grid)

    def fn_vector(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 1)
        return Vector(self.constant(self.scalar(e.args[0], grid), grid))

    def fn_scalar(self, e: ast.Call, grid: Grid) -> Scalar:
        self.arity(e, 1)
        one = self.vector(e.args[0], grid).df.groupBy("k").agg(F.count("*").alias("n"), F.first("value").alias("v"))
        value = F.when(F.col("n") == 1, F.col("v")).otherwise(F.lit(math.nan))
        return Scalar(df=grid.frame(self.spark).join(one, "k", "left").select("k", F.coalesce(value, F.lit(math.nan)).alias("scalar")))

    def fn_time(self, e: ast.Call, grid: Grid) -> Scalar:
        self.arity(e, 0)
        return self.time(grid)

    def fn_pi(self, e: ast.Call, grid: Grid) -> Scalar:
        self.arity(e, 0)
        return Scalar.number(math.pi)

    def fn_timestamp(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 1)
        v = self.vector(e.args[0], grid).df
        return Vector(v.select("k", L.drop_name(F.col("sig")).alias("sig"), (F.col("ots_ns") / 1e9).alias("value"), "ots_ns"))

    def with_scalars(self, e: ast.Call, grid: Grid, count: int) -> tuple[DataFrame, list[Column]]:
        df = self.vector(e.args[0], grid).df
        for i in range(count):
            df = self.scalar(e.args[1 + i], grid).attach(df, f"s{i}")
        return df, [F.col(f"s{i}") for i in range(count)]

    def fn_round(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 1, 2)
        if len(e.args) == 1:
            e = ast.Call(e.name, [*e.args, ast.Number(1.0)])
        df, (to,) = self.with_scalars(e, grid, 1)
        return self.mapped(Vector(df), lambda v: I.round_to(v, to))

    def fn_clamp(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 3)
        df, (low, high) = self.with_scalars(e, grid, 2)
        return self.mapped(Vector(df.where(~(high < low) | F.isnan(low))), lambda v: I.clamp_max(I.clamp_min(v, low), high))

    def fn_clamp_min(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 2)
        df, (low,) = self.with_scalars(e, grid, 1)
        return self.mapped(Vector(df), lambda v: I.clamp_min(v, low))

    def fn_clamp_max(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 2)
        df, (high,) = self.with_scalars(e, grid, 1)
        return self.mapped(Vector(df), lambda v: I.clamp_max(v, high))

    def fn_sort(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 1)
        return Vector(self.vector(e.args[0], grid).df.orderBy("k", F.isnan("value"), "value", "sig"))

    def fn_sort_desc(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 1)
        return Vector(self.vector(e.args[0], grid).df.orderBy("k", F.isnan("value"), F.col("value").desc(), "sig"))

    def fn_label_replace(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 5)
        target, replacement, source, pattern = map(self.text, e.args[1:])
        if not _LABEL.match(target):
            raise InvalidLabelName(target)
        have = L.label(F.col("sig"), source)
        whole = f"^(?s:{pattern})$"
        groups = re.compile(pattern).groups
        names = re.compile(pattern).groupindex
        parts: list[Column] = []
        at = 0
        for m in re.finditer(r"\$(?:\$|\{(\w+)\}|(\w+))", replacement):
            parts.append(F.lit(replacement[at : m.start()]))
            at = m.end()
            ref = m[1] or m[2]
            number = None if ref is None else int(ref) if ref.isdigit() else names.get(ref)
            if ref is None:
                parts.append(F.lit("$"))
            elif number is not None and number <= groups:
                parts.append(F.regexp_extract(have, whole.replace("(?P<", "(?<"), number))
        parts.append(F.lit(replacement[at:]))
        now = F.concat(*parts)
        changed = L.sig_of(F.map_concat(F.map_filter(L.map_of(F.col("sig")), lambda k, v: k != target), F.create_map(F.lit(target), now)))
        df = self.vector(e.args[0], grid).df
        return Vector(df.withColumn("sig", F.when(have.rlike(whole.replace("(?P<", "(?<")), changed).otherwise(F.col("sig"))))

    def fn_label_join(self, e: ast.Call, grid: Grid) -> Vector:
        if len(e.args) < 3:
            raise Parse("wrong number of arguments for label_join")
        target, separator, *sources = map(self.text, e.args[1:])
        for x in (target, *sources):
            if not _LABEL.match(x):
                raise InvalidLabelName(x)
        joined = F.concat_ws(separator, *[L.label(F.col("sig"), s) for s in sources]) if sources else F.lit("")
        changed = L.sig_of(F.map_concat(F.map_filter(L.map_of(F.col("sig")), lambda k, v: k != target), F.create_map(F.lit(target), joined)))
        return Vector(self.vector(e.args[0], grid).df.withColumn("sig", changed))

    def hist_field(self, e: ast.Call, grid: Grid, f) -> Vector:
        """A number of each native histogram; float series give nothing."""
        self.arity(e, 1)
        v = self.eval(e.args[0], grid)
        if isinstance(v, native.HistVector):
            return self.finished(v.df.select("k", L.drop_name(F.col("sig")).alias("sig"), f(F.col("hist")).alias("value")), grid)
        return Vector(self.vector(e.args[0], grid).df.where(F.lit(False)))

    def fn_histogram_count(self, e: ast.Call, grid: Grid) -> Vector:
        return self.hist_field(e, grid, lambda h: h["count"])

    def fn_histogram_sum(self, e: ast.Call, grid: Grid) -> Vector:
        return self.hist_field(e, grid, lambda h: h["sum"])

    def fn_histogram_avg(self, e: ast.Call, grid: Grid) -> Vector:
        return self.hist_field(e, grid, lambda h: I.divide(h["sum"], h["count"]))

    def fn_histogram_quantile(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 2)
        v = self.eval(e.args[1], grid)
        if isinstance(v, native.HistVector):
            named = self.scalar(e.args[0], grid).attach(v.df.withColumn("sig", L.drop_name(F.col("sig"))), "q")
            return self.finished(native.quantiles(named), grid)
        return self.finished(histogram.quantile(self.vector(e.args[1], grid).df, self.scalar(e.args[0], grid).attach), grid)

    def fn_histogram_fraction(self, e: ast.Call, grid: Grid) -> Vector:
        self.arity(e, 3)
        low, high = self.scalar(e.args[0], grid), self.scalar(e.args[1], grid)
        v = self.eval(e.args[2], grid)
        if isinstance(v, native.HistVector):
            named = v.df.withColumn("sig", L.drop_name(F.col("sig")))
            return self.finished(native.fractions(high.attach(low.attach(named, "lower"), "upper")), grid)
        return self.finished(histogram.fraction(self.vector(e.args[2], grid).df, low.attach, high.attach), grid)

    # aggregations

    def aggregate(self, e: ast.Aggregate, grid: Grid) -> Vector:
        group = F.lit("{}") if e.by is None else L.keep(F.col("sig"), e.labels) if e.by else L.drop(F.col("sig"), [*e.labels, "__name__"])
        inner = self.eval(e.expr, grid)
        if isinstance(inner, native.HistVector):
            rows = inner.df.withColumn("g", group)
            if e.op in ("sum", "avg"):
                out = native.added(rows, e.op == "avg")
                return native.HistVector(out.select("k", F.col("g").alias("sig"), "hist", grid.time(F.col("k")).alias("ots_ns")))
            if e.op in ("count", "group"):
                value = F.count("*").cast("double") if e.op == "count" else F.max(F.lit(1.0))
                return self.finished(rows.groupBy("k", F.col("g").alias("sig")).agg(value.alias("value")), grid)
            return self.finished(rows.where(F.lit(False)).select("k", F.col("g").alias("sig"), F.lit(0.0).alias("value")), grid)
        if not isinstance(inner, Vector):
            raise WrongType("an instant vector is needed")
        df, v = inner.df, F.col("value")
        rows = df.withColumn("g", group)
        if e.op in ("topk", "bottomk"):
            k = self.scalar(e.param, grid)
            order = v.desc() if e.op == "topk" else v.asc()
            by = Window.partitionBy("k", "g").orderBy(F.isnan(v), order, "sig")
            ranked = k.attach(rows).withColumn("place", F.row_number().over(by))
            return Vector(ranked.where(~F.isnan("scalar") & (F.col("place") <= F.col("scalar"))).select("k", "sig", "value", "ots_ns"))
        if e.op == "count_values":
            name = self.text(e.param)
            if not _LABEL.match(name):
                raise InvalidLabelName(name)
            counted = rows.groupBy("k", "g", I.label_text(v).alias("text")).agg(F.count("*").cast("double").alias("value"))
            sig = L.sig_of(F.map_concat(F.map_filter(L.map_of(F.col("g")), lambda k, x: k != name), F.create_map(F.lit(name), F.col("text"))))
            return self.finished(counted.select("k", sig.alias("sig"), "value"), grid)
        if e.op == "quantile":
            q = self.scalar(e.param, grid)
            if q.constant is None:
                raise Unsupported("quantile takes a constant")
            value = rangefn.bounded_quantile(v, q.constant)
        else:
            value = {
                "sum": lambda: F.sum(v), "avg": lambda: F.avg(v), "min": lambda: rangefn.skip_nan(F.min, v), "max": lambda: rangefn.skip_nan(F.max, v),
                "count": lambda: F.count("*").cast("double"), "group": lambda: F.max(F.lit(1.0)), "stddev": lambda: rangefn.variance(F.stddev_pop, v), "stdvar": lambda: rangefn.variance(F.var_pop, v),
            }[e.op]()
        return self.finished(rows.groupBy("k", F.col("g").alias("sig")).agg(value.alias("value")), grid)

    # operators

    def binary(self, e: ast.Binary, grid: Grid) -> Vector | Scalar:
        left, right = self.eval(e.left, grid), self.eval(e.right, grid)
        if isinstance(left, Text) or isinstance(right, Text):
            raise WrongType("strings have no operators")
        both = isinstance(left, Vector) and isinstance(right, Vector)
        if e.op in ("and", "or", "unless"):
            if not both:
                raise WrongType("set operators need vectors")
            return self.set_operation(e, left.df, right.df)
        compares = e.op in I.COMPARISON
        if both:
            return self.matched(e, left.df, right.df, grid)
        if isinstance(left, Vector) or isinstance(right, Vector):
            df, other = (left.df, right) if isinstance(left, Vector) else (right.df, left)
            rows = other.attach(df)
            a, b = (F.col("value"), F.col("scalar")) if isinstance(left, Vector) else (F.col("scalar"), F.col("value"))
            if compares and not e.bool_:
                return Vector(rows.where(I.COMPARISON[e.op](a, b)).select("k", "sig", "value", "ots_ns"))
            return self.mapped(Vector(rows), lambda _: self.computed(e.op, a, b))
        if compares and not e.bool_:
            raise Parse("comparisons between scalars need bool")
        constant = None
        if left.df is None and right.df is None:
            if left.constant is not None and right.constant is not None and e.op in ("+", "-", "*"):
                constant = {"+": left.constant + right.constant, "-": left.constant - right.constant, "*": left.constant * right.constant}[e.op]
            return Scalar(of=lambda k: self.computed(e.op, left.of(k), right.of(k)), constant=constant)
        rows = right.attach(left.attach(grid.frame(self.spark), "a"), "b")
        return Scalar(df=rows.select("k", self.computed(e.op, F.col("a"), F.col("b")).alias("scalar")))

    @staticmethod
    def computed(op: str, a: Column, b: Column) -> Column:
        return I.COMPARISON[op](a, b).cast("double") if op in I.COMPARISON else I.ARITHMETIC[op](a, b)

    @staticmethod
    def match_key(m: ast.Matching | None) -> Column:
        sig = F.col("sig")
        if m is None:
            return L.drop_name(sig)
        return L.keep(sig, m.labels) if m.on else L.drop(sig, [*m.labels, "__name__"])

    def set_operation(self, e: ast.Binary, left: DataFrame, right: DataFrame) -> Vector:
        key = self.match_key(e.matching)
        left, right = left.withColumn("m", key), right.withColumn("m", key)
        if e.op == "or":
            out = left.unionByName(right.join(left.select("k", "m").distinct(), ["k", "m"], "left_anti"))
        else:
            out = left.join(right.select("k", "m"), ["k", "m"], "left_semi" if e.op == "and" else "left_anti")
        return Vector(out.select("k", "sig", "value", "ots_ns"))

    def matched(self, e: ast.Binary, left: DataFrame, right: DataFrame, grid: Grid) -> Vector:
        """Join on the match key; the side that must be unique raises where it is not."""
        m = e.matching or ast.Matching()
        key = self.match_key(e.matching)
        swapped = m.group == "right"
        many, one = (right, left) if swapped else (left, right)
        many = many.select("k", key.alias("m"), F.col("sig").alias("sig"), F.col("value").alias("mv"))
        one = one.select("k", key.alias("m"), F.col("sig").alias("one_sig"), F.col("value").alias("ov")).groupBy("k", "m").agg(F.first("one_sig").alias("one_sig"), F.first("ov").alias("ov"), F.count("*").alias("ones"))
        ambiguous = F.raise_error(F.concat(F.lit("AmbiguousMatch: several series for "), F.col("m")))
        # a filter below the join: a repeated key is an error even where nothing meets it
        one = one.where(F.when(F.col("ones") > 1, ambiguous.cast("boolean")).otherwise(F.lit(True)))
        rows = many.join(one, ["k", "m"])
        problem = F.lit(False)
        if m.group is None:
            rows = rows.withColumn("many", F.count("*").over(Window.partitionBy("k", "m")))
            problem = F.col("many") > 1
        a, b = (F.col("ov"), F.col("mv")) if swapped else (F.col("mv"), F.col("ov"))
        compares = e.op in I.COMPARISON
        keeps = compares and not e.bool_
        value = a if keeps else self.computed(e.op, a, b)
        guarded = F.when(problem, ambiguous.cast("double")).otherwise(value)
        if m.group is not None:
            sig = F.col("sig") if keeps else L.drop_name(F.col("sig"))
            if m.include:
                copied = F.map_filter(L.map_of(F.col("one_sig")), lambda k, v: k.isin(m.include))
                sig = L.sig_of(F.map_concat(F.map_filter(L.map_of(sig), lambda k, v: ~k.isin(m.include)), copied))
        elif m.on:
            sig = L.keep(F.col("sig"), m.labels)
        else:
            dropped = [*m.labels] if keeps else [*m.labels, "__name__"]
            sig = L.drop(F.col("sig"), dropped) if dropped else F.col("sig")
        if keeps:
            rows = rows.where(problem | I.COMPARISON[e.op](a, b))
        out = rows.select("k", sig.alias("sig"), guarded.alias("value"))
        if m.group is not None:
            # labels that were dropped or copied may have told series apart
            alike = F.count("*").over(Window.partitionBy("k", "sig")) > 1
            out = out.withColumn("alike", alike).select("k", "sig", F.when(F.col("alike"), F.raise_error(F.concat(F.lit("AmbiguousMatch: several results for "), F.col("sig"))).cast("double")).otherwise(F.col("value")).alias("value"))
        return self.finished(out, grid)


def run(spark: SparkSession, source: SeriesSource, query: str, grid: Grid, lookback: int = LOOKBACK) -> Vector | Scalar | Text:
    """Compile a whole query."""
    return Evaluator(spark, source, grid, lookback).eval(parse(query), grid)


def as_frame(spark: SparkSession, value: Vector | Scalar | Text, grid: Grid) -> DataFrame:
    """``labels`` (canonical JSON), ``ts_ns`` and ``value`` of a compiled query."""
    if isinstance(value, Text):
        return spark.range(grid.n).select(F.lit("{}").alias("labels"), grid.time(F.col("id")).alias("ts_ns"), F.lit(value.value).alias("value"))
    if isinstance(value, native.HistVector):
        return value.df.select(F.col("sig").alias("labels"), grid.time(F.col("k")).alias("ts_ns"), "hist")
    df = value.df if isinstance(value, Vector) else value.attach(grid.frame(spark).withColumn("sig", F.lit("{}")), "value")
    return df.select(F.col("sig").alias("labels"), grid.time(F.col("k")).alias("ts_ns"), "value")


__all__ = ["AmbiguousMatch", "Evaluator", "as_frame", "run"]
