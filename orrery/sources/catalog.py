"""Tables and views by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_tables(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Each frame as a temporary view, so that any SELECT can name it."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)
