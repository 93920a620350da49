"""Names of the queries, their functions and their SQL.

A query is a function (spark, sf_dir) -> DataFrame; ``sql`` is DuckDB SQL for the
same rows over the same tables, or None where SQL cannot express it (such queries
have tests against brute force or invariants instead).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries in the order of their registration."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.rows: dict[str, tuple[int, ...]] = {}

    def query(self, name: str, sql: str | None = None, rows: tuple[int, ...] = ()) -> Callable[[Query], Query]:
        """Register a function; ``rows`` are the rows of the operator inventory that it covers."""

        def put(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            self.rows[name] = rows
            if sql is not None:
                self.sql[name] = sql
            return f

        return put
