"""Dashboard queries: dimensions, measures, filters, sort and limit over a view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklake.functions.scalars import round_scaled

LATEST = "is_latest = 1"


def visual(view: DataFrame, dims: list[str], measures: dict[str, Column], filters: list[str] = (), sort: list[Column] = (),
           limit: int | None = None) -> DataFrame:
    """SELECT dims, measures FROM view WHERE filters GROUP BY dims ORDER BY sort LIMIT limit. No dims: a tile."""
    for f in filters:
        view = view.where(f)
    out = view.groupBy(*dims).agg(*[c.alias(n) for n, c in measures.items()])
    if sort:
        out = out.orderBy(*sort)
    return out.limit(limit) if limit else out


def percent(measure: Column) -> Column:
    return round_scaled(100 * measure, 1)


def missing_columns(view: DataFrame, used: list[str]) -> list[str]:
    """Columns a visual names that its view lacks."""
    return sorted(set(used) - set(view.columns))


def tile_agrees(tile: DataFrame, recomputed: DataFrame, column: str, tolerance: float = 1e-6) -> DataFrame:
    """Tile value against an independent computation; both have one row."""
    other = recomputed.select(F.col(column)).scalar()
    return tile.select(F.col(column).cast("double").alias("tile"), other.cast("double").alias("recomputed"),
                       (F.abs(F.col(column) - other) <= tolerance).alias("agrees"))


def ask(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """Any SQL over frames, named as in the text: {name}."""
    return spark.sql(sql, **views)
