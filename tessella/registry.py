"""Registry of the engine's queries over the sample tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.relations import load, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a loader of relations, and its SQL."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(lambda r: load(spark, sf_dir, r))
        if sql is not None:
            ORACLE_SQL[name] = with_relations(sql)
        return fn

    return register
