"""The registry of the queries and helpers that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..registry import Registry
from ..sources.tables import Tables

REGISTRY = Registry()


def query(name: str, sql: str | None = None, rows: tuple[int, ...] = ()) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the tables as query ``name``."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        REGISTRY.query(name, sql, rows)(run)
        return f

    return put
