"""Incremental build, currency and integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parity(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows of either frame the other lacks."""
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.exceptAll(b), "left").union(count(b.exceptAll(a), "right"))


def null_census(df: DataFrame) -> DataFrame:
    """(column, nulls) of every column that has nulls, in one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    long = counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns))).alias("x"))
    return long.select("x.column", "x.nulls").where("nulls > 0")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows without a parent."""
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def drift(current: DataFrame, recorded: DataFrame, keys: Sequence[str], signature: Sequence[str], digest: str) -> DataFrame:
    """(keys, state): current, touched (signature moved, digest equal), changed, added or gone."""
    now = current.select(*keys, F.struct(*signature).alias("__s"), F.col(digest).alias("__d"), F.lit(True).alias("__here"))
    then = recorded.select(*keys, F.struct(*signature).alias("__rs"), F.col(digest).alias("__rd"), F.lit(True).alias("__there"))
    both = now.join(then, list(keys), "full_outer")
    state = F.when(F.col("__there").isNull(), "added").when(F.col("__here").isNull(), "gone").when(F.col("__s") == F.col("__rs"), "current").when(F.col("__d") == F.col("__rd"), "touched").otherwise("changed")
    return both.select(*keys, state.alias("state"))


def first_reason(**tests: Column) -> Column:
    """The name of the first test that holds; null if none does."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests.items()):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def all_reasons(**tests: Column) -> Column:
    """The names of all tests that hold, in their order."""
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())), lambda x: x.isNotNull())
