"""Reconciliation: expected against actual counts, stage status, view against view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class StageFailed(RuntimeError):
    """A check of the stage ended in MISMATCH."""


def recon_status(expected: Column, actual: Column, tolerance: float = 0.0, explained: Column | bool = False) -> Column:
    """A NULL on either side never matches."""
    ok = F.abs(actual - expected) <= F.lit(float(tolerance))
    known = F.lit(explained) if isinstance(explained, bool) else explained
    return F.when(F.coalesce(ok, F.lit(False)), "MATCHED").when(known, "EXPLAINED").otherwise("MISMATCH")


def check(df: DataFrame, keys: list[str], stage: str, entity: Column | str, name: str, expected: Column, actual: Column,
          explained: bool = False, tolerance: float = 0.0, detail: Column | None = None) -> DataFrame:
    """One check row per row of df (an aggregate of the stage)."""
    e, a = expected.cast("double"), actual.cast("double")
    return df.select(*keys, F.lit(stage).alias("stage"),
                     (F.lit(entity) if isinstance(entity, str) else entity).alias("entity"),
                     F.lit(name).alias("check_name"), e.alias("expected"), a.alias("actual"),
                     recon_status(e, a, tolerance, explained).alias("status"),
                     (F.lit("") if detail is None else detail).alias("detail"))


def checks(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def replace_stage(old: DataFrame, new: DataFrame, stage: str, run_dates: Column) -> DataFrame:
    """A stage's new checks replace all it wrote before on the dates of the run (a condition on the old rows),
    also when it has none left; other stages and dates stay."""
    return old.where(~((F.col("stage") == stage) & run_dates)).unionByName(new)


def stage_status(check_rows: DataFrame, keys: list[str]) -> DataFrame:
    """COMPLETED or FAILED per stage with the number of checks by status."""
    n = lambda s: F.count_if(F.col("status") == s)
    return check_rows.groupBy(*keys).agg(
        n("MATCHED").alias("matched"), n("EXPLAINED").alias("explained"), n("MISMATCH").alias("mismatched")
    ).withColumn("status", F.when(F.col("mismatched") > 0, "FAILED").otherwise("COMPLETED"))


def audit_rows(check_rows: DataFrame, volumes: DataFrame, keys: list[str]) -> DataFrame:
    """A stage's audit: a row per entity with what came in, went out and was rejected, and the row '*' with their sums.

    volumes: keys, entity, rows_in, rows_out, rows_rejected. An entity whose extract is missing has volumes of NULL and the status MISSING.
    """
    sums = ("rows_in", "rows_out", "rows_rejected")
    lost = F.col("rows_in").isNull()
    entities = volumes.select(*keys, "entity", *sums, F.when(lost, "MISSING").otherwise("COMMITTED").alias("status"))
    total = volumes.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    whole = stage_status(check_rows, keys).join(total, keys, "left").select(*keys, F.lit("*").alias("entity"), *sums, "status", "matched", "explained", "mismatched")
    return whole.unionByName(entities, allowMissingColumns=True)


def require_completed(check_rows: DataFrame) -> None:
    """Stop the pipeline on an unexplained mismatch."""
    bad = check_rows.where("status = 'MISMATCH'").agg(F.count(F.lit(1))).first()[0]
    if bad:
        raise StageFailed(f"{bad} reconciliation mismatch(es)")


def differences(left: DataFrame, right: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Counters that differ between two views of the same key; a missing side counts as 0."""
    def long(df: DataFrame, value: str) -> DataFrame:
        zeroed = df.select(key, *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in counters])
        return zeroed.unpivot(key, counters, "counter", value)

    both = long(left, "left_value").join(long(right, "right_value"), [key, "counter"], "full_outer")
    return both.fillna(0, ["left_value", "right_value"]).where("left_value <> right_value")
