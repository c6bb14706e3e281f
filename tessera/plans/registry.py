"""The catalogue of queries: each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

CALLS: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *tables: str) -> Callable[[Query], Query]:
    """Registers a function under its name; ``tables`` are the table expressions that its SQL needs."""

    def register(f: Query) -> Query:
        CALLS[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {', '.join(tables)} " if tables else "") + sql
        return f

    return register
