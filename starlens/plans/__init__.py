"""Named queries over the shipped tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "sources",
    "aggregates",
    "patterns",
    "analytics",
    "graph",
    "vectors",
    "dictionary",
    "questions",
    "answers",
)


def _loaded():
    return [import_module(f"starlens.plans.{m}") for m in _MODULES]


def all_queries() -> dict:
    return {name: fn for m in _loaded() for name, fn in m.book.queries.items()}


def all_oracles() -> dict:
    return {name: sql for m in _loaded() for name, sql in m.book.oracles.items()}
