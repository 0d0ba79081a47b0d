"""Every registered query of the engine, one for each operator, and the SQL that checks it.

A query takes the tables of a directory and applies one operator to whole
tables. Its name begins with the operator's number in the inventory.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

MODULES = ("scalar_queries", "stat_queries", "ordered_queries", "join_queries", "estimator_queries", "project_queries", "plan_queries", "spectral_queries", "stream_queries", "track_queries", "orbit_queries", "search_queries", "file_queries")


class Tables:
    """The tables of one directory, read when first named."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """A decorator that registers a query, with its SQL if SQL can express it."""

    def add(run: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: run(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return add


def load() -> None:
    for name in MODULES:
        import_module(f"orrery.plans.{name}")
