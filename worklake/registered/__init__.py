"""Queries over the driver's tables, each next to its SQL."""

from __future__ import annotations

from importlib import import_module

from worklake.registered import base

MODULES = ("ingest", "shaping", "queueing", "scoring", "reporting", "features", "evaluation")


def _load() -> None:
    for name in MODULES:
        import_module(f"worklake.registered.{name}")


def all_queries() -> dict:
    _load()
    return dict(base.QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(base.SQL)
