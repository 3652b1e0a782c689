"""Named queries, each with the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str, shared: str = ""):
    """Register ``function(spark, sf_dir)`` under ``key``. ``shared`` is a WITH
    clause put in front of the SQL."""

    def register(function: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = function
        ORACLES[key] = f"{shared}\n{sql}".strip()
        return function

    return register
