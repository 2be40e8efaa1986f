"""Named queries: callables (spark, sf_dir) -> DataFrame, each with the SQL that an independent engine answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from skerry.plans import aggregation, detection, evaluation, intake, joining, operations, ordering, parsing, projection, reports, rollups, rules  # noqa: F401

    return QUERIES, ORACLES
