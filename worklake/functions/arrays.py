"""Statistics of a numeric array column, without leaving the JVM and in one pass over the array each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def moments(a: Column) -> Column:
    """Struct of n, mean and m2 (sum of squared deviations), updated element by element."""
    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        d = x.cast("double") - s["mean"]
        mean = s["mean"] + d / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + d * (x.cast("double") - mean)).alias("m2"))

    return F.aggregate(a, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")), step)


def bends(a: Column) -> Column:
    """Second differences 2a[i] - a[i-1] - a[i+1]: the edge filter of a row of numbers."""
    at = lambda i: F.element_at(a, i).cast("double")
    return F.when(F.size(a) >= 3, F.transform(F.sequence(F.lit(2), F.size(a) - 1), lambda i: 2 * at(i) - at(i - 1) - at(i + 1)))


def sorted_quantile(ordered: Column, p: float) -> Column:
    """Linear interpolation between neighbours of an already sorted array."""
    h = (F.size(ordered) - 1) * F.lit(float(p))
    lo, hi = F.floor(h).cast("int"), F.ceil(h).cast("int")
    low, high = (F.element_at(ordered, i + 1).cast("double") for i in (lo, hi))
    return low + (high - low) * (h - lo)


def array_stats(df: DataFrame, array: str) -> DataFrame:
    """Adds mean, std, p05, p95, spread (p95 - p05), roughness (variance of the second differences), size.
    Deviations are those of the population."""
    a = F.col(array)
    staged = df.select("*", moments(a).alias("_m"), F.sort_array(a).alias("_s"), moments(bends(a)).alias("_b"))
    p05, p95 = sorted_quantile(F.col("_s"), 0.05), sorted_quantile(F.col("_s"), 0.95)
    return staged.select(
        *df.columns, F.col("_m.mean").alias("mean"), F.sqrt(F.col("_m.m2") / F.col("_m.n")).alias("std"), p05.alias("p05"),
        p95.alias("p95"), (p95 - p05).alias("spread"), (F.col("_b.m2") / F.col("_b.n")).alias("roughness"), F.size(a).alias("size"))
