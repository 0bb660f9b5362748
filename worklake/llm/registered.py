"""The queries of this subpackage; each module registers its own."""

from __future__ import annotations

from importlib import import_module

from worklake.llm import common

MODULES = ("mixture", "licenses", "langid", "quality", "pii", "fagin", "edits", "bpe", "counts", "jaccard", "secrets", "treap", "collocations")


def all_queries() -> dict:
    for name in MODULES:
        import_module(f"worklake.llm.{name}")
    return dict(common.QUERIES)


def all_sql() -> dict[str, str]:
    all_queries()
    return dict(common.SQL)
