"""Fact and dimension joins of the gold layer.

No join is hinted: Spark broadcasts a side whose size it knows to be small, and AQE splits the skewed
partitions of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklake.operators.latest import latest_per_key


def latest_in_window(requests: DataFrame, date: Column, dates: Column, keys: list[str], order: list[Column]) -> DataFrame:
    """One request per key out of the window of dates, so that a key sent on two dates cannot multiply facts."""
    return latest_per_key(requests.where(dates), keys, order)


def left_with_default(facts: DataFrame, side: DataFrame, on: list[str], defaults: dict[str, str], flag: str) -> DataFrame:
    """Left join with defaults for missing values and a flag that tells whether there was a match."""
    marked = side.withColumn(flag, F.lit(True))
    out = facts.join(marked, on, "left")
    for c, value in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(value)))
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def moved_by(left: DataFrame, right: DataFrame, key: str, also: str) -> DataFrame:
    """Inner join on key and also, whose rows are moved by key alone.

    A side that a join on key has moved stays where it is, and so does the result for the next one. `also` is compared where the rows meet:
    as an equality Spark would take it for a second key and move both sides again.
    """
    other = right.withColumnRenamed(also, "_also")
    return left.join(other, key).where(F.array_contains(F.array(also), F.col("_also"))).drop("_also")


def orphans(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_anti")


def found(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_semi")
