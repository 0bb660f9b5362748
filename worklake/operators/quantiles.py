"""Exact quantiles per group, for groups of any size, by rank: equal values collapse to counts, a prefix scan gives their ranks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.operators.ordered import CHUNK, SUM, chunk, running
from worklake.session import materialize

LINEAR, INDEX = "linear", "index"


def _positions(n: Column, p: float, method: str) -> tuple[Column, Column, Column, Column]:
    """(low, high, weight of low, weight of high), 0-based positions in the sorted group of n values."""
    if method == LINEAR:
        h = (n - 1) * F.lit(float(p))
        return F.floor(h), F.ceil(h), F.ceil(h) - h, h - F.floor(h)
    # INDEX: the value at int(p * n), never past the end; no interpolation
    at = F.least(n - 1, F.floor(F.lit(float(p)) * n))
    return at, at, F.lit(0.0), F.lit(0.0)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float | tuple[float, str]],
                    times: str | None = None) -> DataFrame:
    """One row per group with a column per entry of probs: name -> probability, or (probability, method).

    linear interpolates between neighbours; index takes the value at position int(p * n). NULLs are ignored.
    times: a column that says how often a row counts.
    """
    wanted = {n: p if isinstance(p, tuple) else (p, LINEAR) for n, p in probs.items()}
    by = keys or ["_all"]
    rows = df.where(F.col(value).isNotNull())
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    # equal values collapse before anything is sorted, so a hot group brings its distinct values, not its rows
    counts = chunk(rows.groupBy(*by, F.col(value).alias("_v")).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_c")), by, [F.col("_v")])
    placed = running(counts, by, [F.col("_v")], {"_upto": (SUM, F.col("_c"))}).drop(CHUNK)
    # stored, because its size tells Spark whether the counts have to move for it
    sizes = materialize(counts.groupBy(*by).agg(F.sum("_c").alias("_n")).select(*[F.col(k).alias(f"_s_{k}") for k in by], "_n"), "sizes")
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in by])
    placed = placed.join(sizes, same)
    first = F.col("_upto") - F.col("_c")

    def at(pos: Column) -> Column:
        return F.max(F.when((pos >= first) & (pos < F.col("_upto")), F.col("_v")))

    aggs = []
    for name, (p, method) in wanted.items():
        lo, hi, below, above = _positions(F.col("_n"), p, method)
        # a value itself where both neighbours are equal
        aggs.append(F.when(at(lo) == at(hi), at(lo)).otherwise(at(lo) * F.max(below) + at(hi) * F.max(above)).alias(name))
    return placed.groupBy(*by).agg(*aggs).select(*keys, *wanted)
