"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    """Registers a query with its DuckDB twin; None where SQL cannot express it."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return put
