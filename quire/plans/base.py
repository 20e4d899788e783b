"""Named queries, each bound to the tables it runs on, and the SQL that tells the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.sources.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def bind(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame; sql may use the derived views."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = with_views(sql)
        return function

    return add
