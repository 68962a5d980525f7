"""Queries: operators bound to tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: The operator rows that each query covers.
COVERS: dict[str, list[str]] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = covers.split()
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def load() -> None:
    from . import caches, codecs, identity, lookups, measures, prefixes, routes, serving, stores, versions  # noqa: F401
