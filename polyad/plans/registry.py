"""Named queries with their SQL. A module of queries makes a ``Registry`` and fills it with ``query``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and the DuckDB SQL of those that SQL can express over whole tables."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name."""

        def add(function: Query) -> Query:
            self.queries[function.__name__] = function
            if sql:
                self.sql[function.__name__] = sql
            return function

        return add
