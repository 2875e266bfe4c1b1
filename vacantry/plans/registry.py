"""Registry of the queries that run over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacantry.plans.testbed import Testbed, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), **extra: str):
    """Registers ``fn(testbed) -> DataFrame`` and the SQL that must give the same rows."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Testbed(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views, **extra) if views or extra else sql
        return fn

    return register
