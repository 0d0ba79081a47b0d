"""Wide-band measures of waterfalls: what is new against a baseline, and edges of broad signals, with their controls.

Rows are those of `orrery.operators.searches`: (capture, receiver, row, t, level).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.currency import all_reasons
from orrery.operators.events import kernel
from orrery.operators.searches import levelled, middle, prominent, registered, residuals, total, windowed
from orrery.operators.stats import percentiles
from orrery.sources.scratch import written


def medians(rows: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """(keys, profile): each bin's median over a group's rows."""
    each = rows.select(*keys, F.posexplode(level).alias("bin", "x")).groupBy(*keys, "bin").agg(F.median("x").alias("m"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "m"))), lambda s: s["m"]).alias("profile"))  # as many values as bins


def baselines(rows: DataFrame) -> DataFrame:
    """(receiver, base, spread, coverage): the median over captures of each bin of their levelled profiles, 1.4826 times its median deviation, and how many captures there were."""
    own = medians(rows, ["capture", "receiver"], "level").select("capture", "receiver", levelled(F.col("profile")).alias("profile"))
    own = written(own, "profiles")
    base = medians(own, ["receiver"], "profile").withColumnRenamed("profile", "base")
    off = own.join(base, "receiver").select("receiver", F.zip_with("profile", "base", lambda x, m: F.abs(x - m)).alias("off"))
    spread = medians(off, ["receiver"], "off").select("receiver", F.transform("profile", lambda x: x * 1.4826).alias("spread"))
    return base.join(spread, "receiver").join(own.groupBy("receiver").agg(F.count("*").alias("coverage")), "receiver")


def smooth(values: Column, sigma: float) -> Column:
    """An array under a Gaussian that is cut at four sigma; the ends repeat their last value."""
    weights = kernel(sigma)
    radius, last = len(weights) // 2, F.size(values) - 1
    w = F.array(*map(F.lit, weights))
    at = lambda i: F.get(values, F.greatest(F.lit(0), F.least(last, i)))
    return F.transform(values, lambda _, i: F.aggregate(F.sequence(F.lit(-radius), F.lit(radius)), F.lit(0.0), lambda s, d: s + F.get(w, d + radius) * at(i + d)))


def strongest(profile: np.ndarray, least: float, most: int) -> list[int]:
    """Bins of the most prominent peaks; where these are fewer, then the highest bins at or above 0 that touch none chosen."""
    chosen = [p for p, _ in prominent(profile, least, most)]
    for i in np.argsort(-profile, kind="stable"):
        if len(chosen) >= most or profile[i] < 0:
            break
        if all(abs(int(i) - c) >= 2 for c in chosen):
            chosen.append(int(i))
    return chosen


def novelty(rows: DataFrame, base: DataFrame, threshold: float = 0.35, trend: float = 100.0, reach: int = 50, peaks: int = 20, prominence: float = 0.05) -> DataFrame:
    """(capture, receiver): how far spectra depart from their receiver's baseline, and the bins (of the baseline) that do so most.

    A capture's profile is first registered to the baseline by at most `reach` bins. Rows, less their median and the
    model, lose their broad trend; what is left is new beyond the threshold or three spreads of the bin, whichever is
    higher. Bins that the shift takes out of the baseline are not judged, nor are spectra of another length.
    """
    own = medians(rows, ["capture", "receiver"], "level").select("capture", "receiver", levelled(F.col("profile")).alias("profile"))
    limit = F.least(F.lit(reach), F.floor(F.size("base") / 4).cast("int"))
    placed = own.join(base, "receiver").where(F.size("profile") == F.size("base")).withColumn("b", registered(F.col("base"), F.col("profile"), limit))
    n, lag = F.size("base") - F.abs("b.lag"), F.col("b.lag")
    mine, theirs = F.greatest(F.lit(0), lag) + 1, F.greatest(F.lit(0), -lag) + 1
    models = placed.select(
        "capture", "receiver", "coverage", lag.alias("lag"), F.col("b.r").alias("registration"), n.alias("n"), mine.alias("mine"), (theirs - 1).alias("first"),
        F.slice("base", theirs, n).alias("model"), F.transform(F.slice("spread", theirs, n), lambda s: F.greatest(F.lit(threshold), 3 * s)).alias("limit"),
    )
    whole = rows.join(models, ["capture", "receiver"]).where(F.size("level") >= F.col("mine") + F.col("n") - 1)
    gone = whole.withColumn("gap", F.zip_with(F.slice(levelled(F.col("level")), F.col("mine"), F.col("n")), "model", lambda x, m: x - m))
    gone = written(gone.select("capture", "receiver", "coverage", "lag", "registration", "first", "limit", "gap"), "profiles")
    left = gone.withColumn("left", F.zip_with("gap", smooth(F.col("gap"), trend), lambda x, m: x - m))
    cells = written(left.select("capture", "receiver", "coverage", "lag", "registration", (F.posexplode(F.arrays_zip("left", "limit"))).alias("i", "z"), "first").select("capture", "receiver", "coverage", "lag", "registration", (F.col("first") + F.col("i")).alias("bin"), F.col("z.left").alias("x"), F.col("z.limit").alias("limit")), "profiles")
    size = percentiles(cells.withColumn("size", F.abs("x")), ["capture", "receiver"], "size", {"median_abs": 0.5, "p99_abs": 0.99}).drop("n")
    facts = cells.groupBy("capture", "receiver", "coverage", "lag", "registration").agg(
        F.avg((F.col("x") > F.col("limit")).cast("double")).alias("positive"), F.avg((F.col("x") < -F.col("limit")).cast("double")).alias("negative"),
    ).join(size, ["capture", "receiver"])
    top = cells.groupBy("capture", "receiver", "bin").agg(F.max(F.col("x") - F.col("limit")).alias("excess"))
    profile = top.groupBy("capture", "receiver").agg(F.sort_array(F.collect_list(F.struct("bin", "excess"))).alias("p"))  # as many values as bins
    best = F.pandas_udf(lambda p: p.map(lambda x: strongest(np.array(x, float), prominence, peaks)), "array<int>")
    ranked = profile.select("capture", "receiver", F.col("p.bin").alias("bins"), best(F.col("p.excess")).alias("at"))
    return facts.join(ranked.select("capture", "receiver", F.transform("at", lambda i: F.get("bins", i)).alias("strongest")), ["capture", "receiver"])


def edges(rows: DataFrame, bin_hz: float, width: float, step: float, threshold: float = 0.12, least_hz: float = 100_000.0) -> DataFrame:
    """(capture, receiver, start): drift of the centre and of both edges of what is active in each sliding window, with controls and reasons.

    A row is active from its first to its last bin that departs from the bin's median by the threshold, if these lie
    `least_hz` or more apart; a window needs four such rows. Edges qualify if both move alike, in a line, by three bins or
    more, and the width stays. The centre never does: it moves when power shifts inside the signal.
    """
    flat = residuals(rows)
    weights = F.transform("flat", lambda x: F.greatest(F.abs(x) - threshold / 2, F.lit(0.0)))
    active = F.filter(F.transform("w", lambda x, i: F.when(x >= threshold / 2, i)), lambda i: i.isNotNull())
    told = flat.withColumn("w", weights).withColumn("on", active).where(F.size("on") >= 2)
    strength = total(F.transform("on", lambda i: F.abs(F.get("flat", i)))) / F.size("on")
    path = windowed(flat.select("capture", "receiver", "row", "t"), ["capture", "receiver"], width, step, 4).join(
        told.select("capture", "receiver", "row", (F.array_min("on") * bin_hz).alias("low"), (F.array_max("on") * bin_hz).alias("high"), (total(F.transform("w", lambda x, i: x * i)) / total(F.col("w")) * bin_hz).alias("centre"), strength.alias("strength")),
        ["capture", "receiver", "row"],
    ).where(F.col("high") - F.col("low") >= least_hz)
    off_line = lambda c: F.regr_syy(c, "t") - F.regr_sxy(c, "t") * F.regr_sxy(c, "t") / F.regr_sxx(c, "t")
    measured = path.groupBy("capture", "receiver", "start").agg(
        F.count("*").alias("rows"), F.min("t").alias("first"), F.max("t").alias("last"), *(F.regr_slope(c, "t").alias(f"{c}_drift") for c in ("centre", "low", "high")), F.avg("strength").alias("strength"),
        F.least(F.max("low") - F.min("low"), F.max("high") - F.min("high")).alias("moved"), F.sqrt(F.greatest(F.lit(0.0), off_line("low") + off_line("high")) / (2 * F.count("*"))).alias("rms"), F.collect_list(F.col("high") - F.col("low")).alias("widths"),
    ).where("rows >= 4")
    spread = measured.withColumn("width_hz", middle(F.col("widths"))).withColumn("off", middle(F.zip_with("widths", F.array_repeat("width_hz", F.size("widths")), lambda x, m: F.abs(x - m))))
    whole = spread.withColumns({
        "motion_bins": F.col("moved") / bin_hz, "linearity_bins": F.col("rms") / bin_hz, "width_spread": 1.4826 * F.col("off") / F.greatest("width_hz", F.lit(bin_hz)),
        "edge_difference": F.abs(F.col("low_drift") - F.col("high_drift")),
    }).drop("widths", "off", "moved", "rms")
    why = all_reasons(**{
        "motion below three bins": F.col("motion_bins") < 3, "edges do not move alike": F.col("edge_difference") > F.greatest(F.lit(1000.0), 0.2 * F.greatest(F.abs("low_drift"), F.abs("high_drift"))),
        "width not stable": F.col("width_spread") > 0.2, "motion not linear": F.col("linearity_bins") > 2.5,
    })
    return whole.withColumn("reasons", why).withColumn("qualified", F.size("reasons") == 0)
