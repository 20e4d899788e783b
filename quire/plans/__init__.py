"""Every query of the library, by name."""

from __future__ import annotations

from importlib import import_module

from quire.plans.base import ORACLE_SQL, QUERIES

MODULES = ("documents", "texts", "cache", "chunks", "pages", "stored")


def _load() -> None:
    for name in MODULES:
        import_module(f"quire.plans.{name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    _load()
    return dict(ORACLE_SQL)
