"""Registered queries: a Spark plan and, where SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_RAW_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query; ``sql`` may mention any fragment of ``oracle.TABLES``."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            _RAW_SQL[name] = sql
        return function

    return add


def sql() -> dict[str, str]:
    """Check statements with their fragments in front."""
    return {name: oracle.query(text) for name, text in _RAW_SQL.items()}


def load() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        queries_cases, queries_corpus, queries_eval, queries_files, queries_names,
        queries_neighbors, queries_online, queries_text,
    )
