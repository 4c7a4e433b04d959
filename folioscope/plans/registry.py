"""Queries by name, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.corpus import Corpus
from folioscope.plans.oracle import CORPUS
from folioscope.sources import bridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def corpus_query(name: str, sql: str | None = None):
    """Registers f(corpus) -> DataFrame; ``sql`` goes after the CTEs of the corpus."""

    def register(f: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(bridge.load(spark, sf_dir))
        if sql:
            SQL[name] = CORPUS + sql
        return f

    return register


def table_query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir) -> DataFrame; ``sql`` stands alone."""

    def register(f: Query):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def register(name: str, build: Query, sql: str | None = None, replace: bool = False) -> None:
    """Adds a builder f(spark, sf_dir) of one's own to the queries, with its SQL for DuckDB if there is one."""
    if not callable(build):
        raise TypeError(f"{name}: a builder takes (spark, sf_dir) and returns a DataFrame")
    if name in QUERIES and not replace:
        raise ValueError(f"there is a query {name} already")
    QUERIES[name] = build
    SQL.pop(name, None)
    if sql:
        SQL[name] = sql
