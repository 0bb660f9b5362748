"""Registry of queries over the driver's tables, and SQL assembled from named CTEs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    """A named part of the SQL side. {name} inside refers to another part and pulls it in."""
    CTES[name] = sql


def _needed(sql: str, found: list[str]) -> list[str]:
    import re

    for name in re.findall(r"\{(\w+)\}", sql):
        if name not in found:
            _needed(CTES[name], found)
            found.append(name)
    return found


def sql(body: str) -> str:
    names = _needed(body, [])
    plain = {n: n for n in names}
    parts = [f"{n} AS ({CTES[n].format(**{m: m for m in CTES})})" for n in names]
    return (f"WITH {', '.join(parts)} " if parts else "") + body.format(**plain)


def query(name: str, body: str | None):
    """Register a query with its SQL; None where SQL cannot express it."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if body is not None:
            SQL[name] = sql(body)
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
