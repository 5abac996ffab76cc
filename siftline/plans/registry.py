"""Queries over the given tables by name, with SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "a19_review_queue"


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, folder of tables) under a name, with its SQL."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import aggregates, code, decisions, dependency, evidence, facts, filters, graphs, joins, package, projections, readers, records, routes, sources, windows  # noqa: E402, F401
