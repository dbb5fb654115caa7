"""Classic histograms: quantiles and fractions from cumulative ``le`` buckets, as window functions over each series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsidia.functions import labels as L
from obsidia.functions.instant import divide


def buckets(df: DataFrame) -> DataFrame:
    """Per series without ``le`` and step: bounds, their lower bounds and monotone counts; only with a ``+Inf`` bucket."""
    le = L.label(F.col("sig"), "le")
    bound = F.when(F.lower(le).isin("+inf", "inf"), F.lit(math.inf)).otherwise(F.expr("try_cast(le as double)"))
    rows = df.withColumn("le", le).withColumn("bound", bound).where("bound is not null").select("k", L.drop(F.col("sig"), ["le", "__name__"]).alias("sig"), "bound", "value")
    merged = rows.groupBy("k", "sig", "bound").agg(F.sum("value").alias("count"))
    by = Window.partitionBy("k", "sig").orderBy("bound")
    whole = Window.partitionBy("k", "sig")
    rising = merged.withColumn("count", F.max("count").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rising.withColumns({"below": F.lag("bound").over(by), "less": F.coalesce(F.lag("count").over(by), F.lit(0.0)), "total": F.max("count").over(whole), "top": F.max("bound").over(whole), "place": F.row_number().over(by), "buckets": F.count("*").over(whole)}).where(f"top = double('Infinity') and buckets > 1")


def quantile(df: DataFrame, scalar_df, out_of_range: bool = True) -> DataFrame:
    """``scalar_df`` attaches the quantile ``q`` to rows by step."""
    b = scalar_df(buckets(df), "q")
    rank = F.col("q") * F.col("total")
    picked = b.where((F.col("count") >= rank) | (F.col("bound") == math.inf)).groupBy("k", "sig").agg(F.min_by(F.struct("bound", "below", "less", "count", "total", "q", "place"), "bound").alias("x"))
    x = lambda c: F.col(f"x.{c}")
    low = F.when(x("below").isNull(), F.when(x("bound") <= 0, x("bound")).otherwise(0.0)).otherwise(x("below"))
    inside = low + (x("bound") - low) * divide(x("q") * x("total") - x("less"), x("count") - x("less"))
    inside = F.when(x("below").isNull() & (x("bound") <= 0), x("bound")).otherwise(inside)
    value = F.when(F.isnan(x("q")) | (x("total") == 0) | F.isnan(x("total")), F.lit(math.nan)).when(x("q") < 0, -math.inf).when(x("q") > 1, math.inf).when(x("bound") == math.inf, x("below")).otherwise(inside)
    return picked.select("k", "sig", value.alias("value"))


def fraction(df: DataFrame, attach_low, attach_high) -> DataFrame:
    """Estimated share of observations between two bounds."""
    b = attach_high(attach_low(buckets(df), "lower"), "upper")
    low = F.when(F.col("below").isNull(), F.when(F.col("bound") > 0, 0.0).otherwise(-math.inf)).otherwise(F.col("below"))

    def rank(at: Column) -> Column:
        part = F.when((low == -math.inf) | (F.col("bound") == math.inf), F.when(low == -math.inf, F.col("count")).otherwise(F.col("less"))).otherwise(F.col("less") + (F.col("count") - F.col("less")) * divide(at - low, F.col("bound") - low))
        return F.max(F.when(at >= F.col("bound"), F.col("count")).when(at >= low, part).otherwise(0.0))

    a = b.groupBy("k", "sig").agg(rank(F.col("lower")).alias("a"), rank(F.col("upper")).alias("b"), F.max("total").alias("total"), F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    value = F.when(F.isnan("lower") | F.isnan("upper") | (F.col("total") == 0), F.lit(math.nan)).when(F.col("lower") >= F.col("upper"), 0.0).otherwise(divide(F.col("b") - F.col("a"), F.col("total")))
    return a.select("k", "sig", value.alias("value"))
