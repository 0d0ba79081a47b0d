"""Vectors and spectral tables as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators import blocks


def cosine_pairs(df: DataFrame, key: str, vector: str, least: float, block: str, connecting: bool = False) -> DataFrame:
    """(l, r, cosine) of pairs of one block that are similar enough; with connecting, enough of them to connect what all connect."""
    return blocks.pairs(df.select(F.col(key).alias("id"), F.col(block).alias("g"), F.col(vector).alias("v")), least, connecting=connecting)


def bins(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """Long form: one row for each bin of a spectrum."""
    return df.select(*keep, F.posexplode(vector).alias("bin", "level")).withColumn("level", F.col("level").cast("double"))


def integrated(long: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Mean level of windows in the power domain; windows of fewer rows are left out."""
    g = long.groupBy(*keys, "bin").agg(F.count("*").alias("rows"), (10 * F.log10(F.avg(F.pow(F.lit(10.0), F.col("level") / 10)))).alias("level"))
    return g.where(F.col("rows") >= least)


def residual(long: DataFrame, capture: str, row: str) -> DataFrame:
    """Levels without each bin's median over time, and then without each row's median."""
    per_bin = long.groupBy(capture, "bin").agg(F.median("level").alias("__b"))
    flat = long.join(per_bin, [capture, "bin"]).withColumn("__r", F.col("level") - F.col("__b"))
    per_row = flat.groupBy(capture, row).agg(F.median("__r").alias("__m"))
    return flat.join(per_row.hint("merge"), [capture, row]).select(capture, row, "bin", (F.col("__r") - F.col("__m")).alias("residual"))


def baseline(long: DataFrame, keys: list[str]) -> DataFrame:
    """Median, scaled median absolute deviation and coverage of each bin."""
    med = long.groupBy(*keys, "bin").agg(F.median("level").alias("median"), F.count("*").alias("coverage"))
    off = long.join(med, [*keys, "bin"]).withColumn("__d", F.abs(F.col("level") - F.col("median")))
    return off.groupBy(*keys, "bin", "median", "coverage").agg((1.4826 * F.median("__d")).alias("spread"))


def best_lag(left: DataFrame, right: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """(keys, lag, r): the shift of right against left that correlates best; both are (keys, bin, level). Null where a side never changes."""
    shifted = left.select(*keys, "bin", F.col("level").alias("__x")).withColumn("lag", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("bin", F.col("bin") + F.col("lag"))
    met = shifted.join(right.select(*keys, "bin", F.col("level").alias("__y")), [*keys, "bin"]).groupBy(*keys, "lag").agg(F.round(F.try_divide(F.covar_pop("__x", "__y"), F.stddev_pop("__x") * F.stddev_pop("__y")), 9).alias("r"))
    return met.groupBy(*keys).agg(F.max_by(F.struct("lag", "r"), F.struct("r", -F.abs("lag"), -F.col("lag"))).alias("b")).select(*keys, "b.lag", "b.r")


def comb(long: DataFrame, keys: list[str], spacing: int, teeth: int) -> DataFrame:
    """Sum over a comb of equally spaced bins round each centre, over the root of the teeth it has."""
    steps = F.explode(F.sequence(F.lit(-(teeth // 2)), F.lit(teeth // 2)))
    rows = long.withColumn("__k", steps).withColumn("centre", F.col("bin") - F.col("__k") * spacing)
    return rows.groupBy(*keys, "centre").agg((F.sum("level") / F.sqrt(F.count("*"))).alias("score"), F.count("*").alias("teeth"))


def slope_bank(long: DataFrame, capture: str, row: str, slopes: list[int]) -> DataFrame:
    """(capture, slope, start, train, holdout): mean level along straight paths, even rows to choose by and odd rows to check."""
    paths = long.withColumn("slope", F.explode(F.array(*map(F.lit, slopes)))).withColumn("start", F.col("bin") - F.col("slope") * F.col(row))
    even = F.col(row) % 2 == 0
    return paths.groupBy(capture, "slope", "start").agg(F.avg(F.when(even, F.col("level"))).alias("train"), F.avg(F.when(~even, F.col("level"))).alias("holdout"), F.count("*").alias("points"))


def pixel_events(pixels: DataFrame, capture: str, row: str, columns: int) -> DataFrame:
    """8-connected groups of pixels: (capture, event, pixels, rows, width, centre). A pixel's number is row * columns + bin within its capture."""
    from orrery.operators.graph import components

    stride = 1 << 40
    numbered = pixels.withColumn("__id", F.col(capture).cast("long") * stride + F.col(row).cast("long") * columns + F.col("bin"))
    steps = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(b).alias("b")) for r, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    near = numbered.withColumn("__s", F.explode(steps)).select(capture, (F.col(row) + F.col("__s.r")).alias(row), (F.col("bin") + F.col("__s.b")).alias("bin"), F.col("__id").alias("a"))
    edges = near.join(numbered.select(capture, row, "bin", F.col("__id").alias("b")).hint("merge"), [capture, row, "bin"]).select("a", "b")
    labels = components(edges, "a", "b").withColumnRenamed("node", "__id")
    whole = numbered.join(labels.hint("merge"), "__id", "left").withColumn("event", F.coalesce("component", "__id") % stride)
    return whole.groupBy(capture, "event").agg(F.count("*").alias("pixels"), F.count_distinct(row).alias("rows"), (F.max("bin") - F.min("bin") + 1).alias("width"), F.round(F.sum(F.col("bin") * F.col("residual")) / F.sum("residual"), 6).alias("centre"))
