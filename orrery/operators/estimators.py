"""Fits, coincidence estimates and resampling as aggregates and columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.scratch import written

#: What rounding may add to a rate or share that is one.
SLACK = 1e-9


def line_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """Slope, intercept and residual RMS of groups with enough points that do not share one x."""
    slope = F.regr_slope(y, x)
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), slope.alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.var_pop(y).alias("__vy"), F.var_pop(x).alias("__vx"))
    rms = F.sqrt(F.greatest(F.lit(0.0), F.col("__vy") - F.col("slope") * F.col("slope") * F.col("__vx")))
    return g.where((F.col("n") >= least) & (F.col("__vx") > 0)).withColumn("rms", rms).drop("__vy", "__vx")


def quadratic_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, weight: Column | None = None) -> DataFrame:
    """c0 + c1 x + c2 x^2 by (weighted) normal equations: nine sums and a closed 3x3 solution."""
    w = F.lit(1.0) if weight is None else weight
    sums = {f"s{k}": F.sum(w * F.pow(x, F.lit(k))) for k in range(5)} | {f"t{k}": F.sum(w * F.pow(x, F.lit(k)) * F.col(y)) for k in range(3)}
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), *(v.alias(k) for k, v in sums.items()))
    s, t = [F.col(f"s{k}") for k in range(5)], [F.col(f"t{k}") for k in range(3)]
    det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    a = [[s[i + j] for j in range(3)] for i in range(3)]
    whole = det(a)
    solved = [det([[t[i] if j == k else a[i][j] for j in range(3)] for i in range(3)]) / whole for k in range(3)]
    return g.where((F.col("n") >= 4) & (F.abs(whole) > 0)).select(*keys, "n", *(c.alias(f"c{k}") for k, c in enumerate(solved)))


def robust_quadratic(df: DataFrame, keys: Sequence[str], x: str, y: str, scale: float, rounds: int = 4) -> DataFrame:
    """The quadratic fit under a soft absolute loss: each round weighs points by their last residual."""
    fit = quadratic_fit(df, keys, x, y)
    for _ in range(rounds):
        joined = df.join(fit.drop("n"), list(keys))
        z = (F.col(y) - F.col("c0") - F.col("c1") * F.col(x) - F.col("c2") * F.col(x) * F.col(x)) / scale
        weighed = joined.withColumn("__w", 1 / F.sqrt(1 + z * z)).drop("c0", "c1", "c2")
        fit = quadratic_fit(weighed, keys, x, y, F.col("__w"))
    return fit


def weighted_line(df: DataFrame, keys: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted offset and drift in closed form."""
    sw, sx, sy = F.sum(w), F.sum(F.col(w) * F.col(x)), F.sum(F.col(w) * F.col(y))
    sxx, sxy = F.sum(F.col(w) * F.col(x) * F.col(x)), F.sum(F.col(w) * F.col(x) * F.col(y))
    g = df.groupBy(*keys).agg(sw.alias("sw"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"), sxy.alias("sxy"))
    d = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    drift = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / d
    return g.where(d > 1e-9).select(*keys, drift.alias("drift"), ((F.col("sy") - drift * F.col("sx")) / F.col("sw")).alias("offset"))


def coincidence(a: Column, b: Column, both: Column, false_rate: Column | float) -> dict[str, Column]:
    """Occupancy f and detection rates dA, dB from three rates when each chain fires falsely at a known rate.

    rates: a = f dA + (1 - f) p with d the rate while occupied; both = f dA dB + (1 - f) p^2. Unsolvable cases are named, never clamped.
    """
    p = false_rate if isinstance(false_rate, Column) else F.lit(float(false_rate))
    u, v, w = a - p, b - p, both - a * p - b * p + p * p
    f = u * v / w
    da, db = p + w / v, p + w / u
    reason = F.when(a.isNull() | b.isNull() | both.isNull(), "no cells").when((u <= 0) | (v <= 0), "no excess").when(w <= 0, "anticoincident").when(f > 1 + SLACK, "occupancy above one").when((da > 1 + SLACK) | (db > 1 + SLACK), "rate above one")
    ok = reason.isNull()
    return {"f": F.when(ok, f), "d_a": F.when(ok, da), "d_b": F.when(ok, db), "reason": reason}


def poisson_weight(seed: int, *keys: str) -> Column:
    """A Poisson(1) draw that is a function of its keys alone, by the inverse of its distribution."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    out, term, total = F.lit(0), 0.36787944117144233, 0.36787944117144233
    marks = []
    for k in range(1, 9):
        marks.append((total, k))
        term /= k
        total += term
    for mark, k in marks:
        out = F.when(u >= mark, F.lit(k)).otherwise(out)
    return out


def bootstrap_rates(cells: DataFrame, keys: Sequence[str], cell: str, a: str, b: str, draws: int, seed: int) -> DataFrame:
    """(keys, draw, n, a, b, both): the three rates of each bootstrap draw; a cell has one weight a draw, whatever its method."""
    drawn = cells.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__w", poisson_weight(seed, "draw", cell))
    fired = lambda *c: F.sum(F.col("__w") * F.least(*(F.col(x).cast("int") for x in c)) if len(c) > 1 else F.col("__w") * F.col(c[0]).cast("int"))
    g = drawn.groupBy(*keys, "draw").agg(F.sum("__w").alias("n"), fired(a).alias("ka"), fired(b).alias("kb"), fired(a, b).alias("kab"))
    return g.where("n > 0").select(*keys, "draw", "n", (F.col("ka") / F.col("n")).alias("a"), (F.col("kb") / F.col("n")).alias("b"), (F.col("kab") / F.col("n")).alias("both"))


def extreme_value_threshold(cells: Column, false_alarm: float) -> Column:
    """The exponential score that the largest of so many cells passes at the false-alarm rate."""
    return -F.log(-F.expm1(F.log1p(F.lit(-false_alarm)) / cells))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """The first value at which half of the group's weight is reached; equal values are one."""
    counted = df.groupBy(*keys, value).agg(F.sum(weight).alias("__w"))
    upto = F.sum("__w").over(Window.partitionBy(*keys).orderBy(value))
    half = F.sum("__w").over(Window.partitionBy(*keys)) / 2
    return counted.withColumns({"__u": upto, "__h": half}).where("__u >= __h").groupBy(*keys).agg(F.min(value).alias(value))


def bootstrap_medians(rows: DataFrame, unit: str, value: str, draws: int, seed: int, margin: float | None = None) -> DataFrame:
    """(draw, value): the weighted median of each bootstrap draw, each unit with its Poisson weight, as `weighted_median` gives it.

    The medians of all draws lie close to that of the rows. Draws count the weights below a bracket of it where the rows
    are, and only rows inside are drawn into a shuffle; a draw whose median is not inside gets a wider bracket, in the
    end all rows.
    """
    rows = written(rows.select(unit, value), "bootstrap")
    v = F.col(value)
    margin = margin or max(8 / max(rows.count(), 1) ** 0.5, 4e-4)
    left, found = list(range(1, draws + 1)), []
    while left:
        whole = margin >= 0.5
        low, high = rows.agg(F.percentile_approx(v, [0.5 - margin, 0.5 + margin], 10_000).alias("c")).first()["c"] or (None, None) if not whole else (None, None)
        whole = whole or low is None
        below = v.isNull() if whole else F.coalesce(v < low, F.lit(True))
        inside = v.isNotNull() if whole else (v >= low) & (v <= high)
        drawn = lambda df: df.withColumn("draw", F.explode(F.lit(left))).withColumn("__w", poisson_weight(seed, "draw", unit)).where("__w > 0")  # noqa: E731, B023
        base = written(drawn(rows).groupBy("draw").agg((F.sum("__w") / 2).alias("__half"), F.coalesce(F.sum(F.when(below, F.col("__w"))), F.lit(0)).alias("__base")), "bootstrap")
        counted = drawn(rows.where(inside)).groupBy("draw", value).agg(F.sum("__w").alias("__w"))
        upto = F.col("__base") + F.sum("__w").over(Window.partitionBy("draw").orderBy(value))
        reached = counted.join(F.broadcast(base), "draw").withColumn("__upto", upto).where("__upto >= __half")  # a row for each draw
        medians = (reached if whole else reached.where("__base < __half")).groupBy("draw").agg(F.min(value).alias(value))
        got = written(base.select("draw").join(medians, "draw", "left") if whole else medians, "bootstrap")
        found.append(got)
        left = [] if whole else sorted(set(left) - {r.draw for r in got.collect()} - (set(left) - {r.draw for r in base.collect()}))  # draws
        margin *= 8
    return reduce(DataFrame.union, found)
