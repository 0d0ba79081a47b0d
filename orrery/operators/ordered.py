"""Window functions and ordered scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: Sequence[str], value: str, out: str, buckets: int = 64) -> DataFrame:
    """The sum up to each row along a total order, without a single task: ranges sum themselves, range totals offset them.

    Ranges are cut at approximate quantiles of the first order column, which must be numeric.
    """
    first = order[0]
    cuts = F.approx_percentile(F.col(first), F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(10_000))
    edges = df.agg(cuts.alias("__cuts"))
    placed = df.join(F.broadcast(edges)).withColumn("__range", F.size(F.filter(F.coalesce("__cuts", F.array()), lambda c: c < F.col(first)))).drop("__cuts")  # one row of `buckets` numbers
    totals = placed.groupBy("__range").agg(F.sum(value).alias("__total"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__range", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("__in", F.sum(value).over(inside)).join(F.broadcast(base), "__range").withColumn(out, F.col("__base") + F.col("__in")).drop("__range", "__in", "__base")  # `buckets` rows


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column, out: str = "island") -> DataFrame:
    """Number the runs of each group: a row for which `opens` is true, or the first one, begins a run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn(out, F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__opens")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, stop: str, gap: float = 0.0, reason: str | None = None) -> DataFrame:
    """Intervals of a group joined where they overlap or lie within the gap: start, stop, how many, and the union of their reasons."""
    earlier = Window.partitionBy(*keys).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1)
    reached = df.withColumn("__reached", F.max(stop).over(earlier))
    runs = islands(reached, keys, [start, stop], F.col(start) > F.col("__reached") + gap, "__run")
    extra = [F.sort_array(F.collect_set(reason)).alias(f"{reason}s")] if reason else []
    return runs.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("parts"), *extra).drop("__run")


def coverage(df: DataFrame, keys: Sequence[str], start: str, stop: str, low: float, high: float) -> DataFrame:
    """The share of [low, high] that the union of a group's intervals covers."""
    clipped = df.select(*keys, F.greatest(start, F.lit(low)).alias("a"), F.least(stop, F.lit(high)).alias("b")).where("a < b")
    earlier = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0.0), F.col("b") - F.greatest(F.col("a"), F.coalesce(F.max("b").over(earlier), F.lit(low))))
    return clipped.withColumn("new", new).groupBy(*keys).agg((F.sum("new") / (high - low)).alias("coverage"))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1, out: str | None = None) -> DataFrame:
    """The first n rows of each group in the order."""
    ranked = df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__place") <= n)
    return ranked.withColumnRenamed("__place", out) if out else ranked.drop("__place")


def margin_gate(df: DataFrame, keys: Sequence[str], score: str, best: str, least_margin: float, most: float) -> DataFrame:
    """The lowest score of each group, how far the second is, and whether both gates are met."""
    w = Window.partitionBy(*keys).orderBy(score, best)
    ranked = df.withColumns({"__p": F.row_number().over(w), "second": F.lead(score).over(w)}).where("__p = 1")
    margin = F.col("second") - F.col(score)
    return ranked.select(*keys, best, score, "second", margin.alias("margin"), ((F.col(score) <= most) & (F.coalesce(margin, F.lit(float("inf"))) >= least_margin)).alias("passed"))
