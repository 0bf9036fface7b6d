"""The registered queries and, where SQL can say the same, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hearthcheck.demo.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"Query registered twice: {name}")
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = with_views(sql)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the base tables and the survey views."""

    def add(run: Query) -> Query:
        register(name, run, sql)
        return run

    return add
