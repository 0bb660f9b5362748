"""Latest row per key, flags for the latest row, flags for the latest date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order. Spark cuts each key to one row before the shuffle
    (WindowGroupLimit), so a key with many copies costs no more than others."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First n rows per group in the given order, again limited before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def copies_per_key(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """The latest row per key and how many copies there were, in one partial aggregate.

    newest: columns that decide which copy is the latest, most important first; all of them are returned.
    """
    best = F.max(F.struct(*newest)).alias("_best")
    return (df.groupBy(*keys).agg(best, F.count(F.lit(1)).alias("copies"))
              .select(*keys, *[F.col(f"_best.{c}").alias(c) for c in newest], "copies"))


def current_per_key(df: DataFrame, keys: list[str], date: str, newest: list[str], first_as: str) -> DataFrame:
    """Slowly changing row: newest version per key with the first date the key was seen, one hash aggregate."""
    return (df.groupBy(*keys).agg(F.max(F.struct(*newest)).alias("_best"), F.min(date).alias(first_as))
              .select(*keys, *[F.col(f"_best.{c}").alias(c) for c in newest], first_as))


def flag_latest(df: DataFrame, keys: list[str], newest: list[str], id_columns: list[str], name: str) -> DataFrame:
    """Every row kept; 1 for the newest row of its key. The newest row is found by a partial aggregate and
    compared after a join, so no group is ever sorted or held whole."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*newest, *id_columns)).alias("_best"))
    best = best.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_best")
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = c if cond is None else cond & c
    same = F.struct(*newest, *id_columns) == F.col("_best")
    return df.join(best, cond, "left").select(*df.columns, same.cast("int").alias(name))


def flag_latest_date(df: DataFrame, date: str, name: str = "is_latest", dates: DataFrame | None = None) -> DataFrame:
    """1 on the newest date. The maximum is a scalar subquery: an unpartitioned window would move every row
    to one task. It is taken from `dates` where those are cheaper to read than df."""
    newest = (df if dates is None else dates).select(F.max(date)).scalar()
    return df.withColumn(name, F.when(F.col(date) == newest, 1).otherwise(0))
