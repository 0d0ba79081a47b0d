"""Which predicted curve a Doppler track follows: candidates by epoch shifts, from coarse to fine, judged on held-out points.

Both searches are joins: points meet their track's candidates and the shifts to
try, and each shifted time meets the two grid values on either side of it by an
equi join on the grid's number; where a curve is a function, its values are
worked out where points and shifts meet, and only the points and the shifts are
shuffled, once a search, by track. What a shift leaves is fitted with an offset and
a bounded drift for each receiver from moments of the training points, so a
group is never gathered: its moments are summed map-side, and errors of the held
points follow from theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.scratch import written

BY = ["track", "number", "shift"]


class Curve(NamedTuple):
    """Every candidate's curve as a function of its number and k, and the first and last k that it covers."""

    value: Callable[[Column, Column], Column]
    first: int
    last: int


def split(points: DataFrame, share: float) -> DataFrame:
    """points with `train`: of each receiver of a track those up to `share` of its span of time; if that leaves either side empty, its earliest `share` of points."""
    own = points.groupBy("track", "receiver").agg(F.min("at").alias("__a"), F.max("at").alias("__b"), F.count("*").alias("__n"))
    by_time = points.join(own, ["track", "receiver"]).withColumn("train", F.col("at") <= F.col("__a") + share * (F.col("__b") - F.col("__a")))
    # A span of no length has no later points; its points are numbered instead.
    flat = F.col("__a") == F.col("__b")
    place = F.row_number().over(Window.partitionBy("track", "receiver").orderBy("at", "observed"))
    cut = F.greatest(F.lit(1), F.least(F.ceil(share * F.col("__n")), F.col("__n") - 1))
    counted = by_time.where(flat).withColumn("__p", place).withColumn("train", F.col("__p") <= cut).drop("__p")
    return by_time.where(~flat).unionByName(counted).drop("__a", "__b", "__n")


def shifts_round(first: float, last: float, step: float) -> list[float]:
    """From first to last by steps, both ends included."""
    n = int((last - first) / step + 1e-9)
    return sorted({first + i * step for i in range(n + 1)} | {last})


def judged(points: DataFrame, tried: DataFrame, curves: DataFrame | Curve, step: float, most_drift: float, common: bool) -> DataFrame:
    """(track, number, shift, train_rms, holdout_rms, nuisance): errors of each shift whose times the curve covers, after each receiver's own line.

    tried is (track, number, shift); curves is (number, k, v, next): the values at k * step and (k + 1) * step; or a Curve.
    """
    t = F.col("at") + F.col("shift")
    # By track on both sides: sums of a track and shift then need no further shuffle, and no shifts go through the driver.
    moved = points.join(tried.hint("merge"), "track").withColumns({"k": F.floor(t / step), "__f": t / step - F.floor(t / step)})
    if isinstance(curves, Curve):
        number, k = F.col("number"), F.col("k")
        met = moved.where(k.between(curves.first, curves.last)).withColumns({"v": curves.value(number, k), "next": curves.value(number, k + 1)})
    else:
        met = moved.join(curves.hint("merge"), ["number", "k"])  # Spark takes a curve's size for that of the row it is made from, and would broadcast them all
    y = F.col("observed") - (F.col("v") + (F.col("next") - F.col("v")) * F.col("__f"))
    rows = met.select(*BY, "receiver", "train", F.col("x"), y.alias("y"), (1 / (F.col("sigma") * F.col("sigma"))).alias("w"), "n")
    on = lambda c: F.when(F.col("train"), c)
    off = lambda c: F.when(~F.col("train"), c)
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    sums = {"sw": F.sum(on(w)), "swx": F.sum(on(w * x)), "swy": F.sum(on(w * y)), "swxx": F.sum(on(w * x * x)), "swxy": F.sum(on(w * x * y)), "met": F.count("*"), "n": F.max("n")}
    for name, side in (("t", on), ("h", off)):
        sums |= {f"n{name}": F.count(side(y)), f"x{name}": F.avg(side(x)), f"y{name}": F.avg(side(y)), f"xx{name}": F.var_pop(side(x)), f"yy{name}": F.var_pop(side(y)), f"xy{name}": F.covar_pop(side(x), side(y))}
    own = rows.groupBy(*BY, "receiver").agg(*(c.alias(k) for k, c in sums.items()))
    spread, slope = F.col("swxx") - F.col("swx") * F.col("swx") / F.col("sw"), F.col("swxy") - F.col("swx") * F.col("swy") / F.col("sw")
    if common:
        over = Window.partitionBy(*BY)  # a row for each receiver
        spread, slope = F.sum(spread).over(over), F.sum(slope).over(over)
    drift = F.when(spread > 1e-9, F.greatest(F.lit(-most_drift), F.least(F.lit(most_drift), slope / spread))).otherwise(0.0)
    fitted = own.withColumn("drift", drift).withColumn("offset", (F.col("swy") - F.col("drift") * F.col("swx")) / F.col("sw"))

    def square(name: str) -> Column:
        c = lambda k: F.col(f"{k}{name}")
        mean = c("y") - F.col("offset") - F.col("drift") * c("x")
        inner = F.greatest(F.lit(0.0), c("yy") - 2 * F.col("drift") * c("xy") + F.col("drift") * F.col("drift") * c("xx"))
        return F.when(c("n") > 0, c("n") * (inner + mean * mean)).otherwise(0.0)

    rms = lambda name: F.sqrt(F.sum(square(name)) / F.nullif(F.sum(f"n{name}"), F.lit(0).cast("long")))  # noqa: E731; a curve that ends inside a track leaves a side without points
    whole = fitted.groupBy(*BY).agg(
        rms("t").alias("train_rms"), rms("h").alias("holdout_rms"), F.sum("met").alias("met"), F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("receiver", "offset", "drift"))).alias("nuisance"),
    )
    return whole.where(F.col("met") == F.col("n")).drop("met", "n")


def associated(
    points: DataFrame, candidates: DataFrame, curves: DataFrame | Curve, step: float, reach: float = 2.0, fine: float = 0.05, coarse: float = 0.5,
    share: float = 0.6, most_drift: float = 200.0, common: bool = False,
) -> DataFrame:
    """The candidates of each track, best held-out error first: number, shift, at_edge, train_rms, holdout_rms, rank, margin (to the next) and nuisance.

    points is (track, receiver, at, observed, sigma), candidates (track, number). A candidate whose curve covers no
    tried shift of all the track's points has no row, and so has a track of fewer than six points, of fewer than three
    on either side of the split, or with a receiver of a single point.
    """
    usable = points.where(F.col("at").isNotNull() & F.col("observed").isNotNull() & (F.col("sigma") > 0)).select("track", "receiver", "at", "observed", "sigma")
    marked = written(split(usable, share), "association")
    lone = marked.groupBy("track", "receiver").count().where("count < 2").select("track").distinct()
    whole = marked.groupBy("track").agg(F.count("*").alias("n"), F.count_if("train").alias("__t"), F.avg(F.when(F.col("train"), F.col("at"))).alias("__ref"))
    good = whole.where((F.col("n") >= 6) & (F.col("__t") >= 3) & (F.col("n") - F.col("__t") >= 3)).join(lone, "track", "left_anti")
    ready = written(marked.join(good, "track").select("track", "receiver", "at", "observed", "sigma", "train", "n", (F.col("at") - F.col("__ref")).alias("x")), "association")
    pairs = candidates.select("track", "number").distinct()
    first = pairs.withColumn("shift", F.explode(F.array(*map(F.lit, shifts_round(-reach, reach, coarse)))))
    order = F.struct("train_rms", "holdout_rms", "stage", "shift")
    best = lambda df: df.groupBy("track", "number").agg(F.min_by(F.struct("shift", "train_rms", "holdout_rms", "nuisance", "stage"), order).alias("b")).select("track", "number", "b.*")
    rough = written(best(judged(ready, first, curves, step, most_drift, common).withColumn("stage", F.lit(0))), "association")
    low, high = F.greatest(F.lit(-reach), F.col("shift") - coarse), F.least(F.lit(reach), F.col("shift") + coarse)
    steps = F.sequence(F.lit(0), F.floor((high - low) / fine + 1e-9).cast("int"))
    near = F.array_distinct(F.concat(F.transform(steps, lambda i: low + i * fine), F.array(high)))
    again = judged(ready, rough.select("track", "number", F.explode(near).alias("shift")), curves, step, most_drift, common).withColumn("stage", F.lit(1))
    found = best(rough.unionByName(again))
    w = Window.partitionBy("track").orderBy("holdout_rms", "train_rms", "number")  # a row for each candidate
    return found.select(
        "track", "number", "shift", (F.abs(F.abs(F.col("shift")) - reach) <= fine / 2 + 1e-9).alias("at_edge"), "train_rms", "holdout_rms",
        F.row_number().over(w).alias("rank"), (F.lead("holdout_rms").over(w) - F.col("holdout_rms")).alias("margin"), "nuisance",
    )


def gated(ranked: DataFrame, most_rms: float, least_margin: float) -> DataFrame:
    """Each track's best candidate, and why it is not taken, if it is not: its held-out error, the margin to the second, or a shift at the search's edge."""
    from orrery.operators.currency import first_reason

    why = first_reason(**{"error": F.col("holdout_rms") > most_rms, "margin": F.coalesce(F.col("margin") < least_margin, F.lit(False)), "edge": F.col("at_edge")})
    return ranked.where("rank = 1").withColumn("refused", why)
