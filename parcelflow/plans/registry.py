"""A module's queries and their SQL twins by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def book() -> tuple[dict[str, Query], dict[str, str], Callable[..., Callable[[Query], Query]]]:
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(name: str, twin: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[name] = f
            if twin:
                sql[name] = twin
            return f

        return add

    return queries, sql, query
