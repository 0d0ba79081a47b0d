"""Searches in waterfalls of two receivers, each score beside the control that could explain it away.

A row is one receiver's spectrum: (capture, receiver, row, t, level), rows
numbered from 0 without gaps, t in seconds, level an array of as many bins as
all others of its capture. Captures are whole numbers, receivers are 0 and 1.
What concerns the bins of a spectrum is done inside the array; rows meet by equi
joins on capture, row or window, so no task holds more than one sliding window.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.currency import all_reasons
from orrery.operators.events import kernel, stretches
from orrery.operators.graph import components
from orrery.operators.selection import suppressed
from orrery.sources.scratch import written


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def middle(values: Column) -> Column:
    """Median of an array without nulls."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(ordered, F.floor(i).cast("int"))
    return (at((n - 1) / 2) + at(n / 2)) / 2


def residuals(rows: DataFrame) -> DataFrame:
    """Rows with `flat`: levels without each bin's median over the rows of its capture and receiver."""
    keys = ["capture", "receiver"]
    median = rows.select(*keys, F.posexplode("level").alias("bin", "x")).groupBy(*keys, "bin").agg(F.median("x").alias("m"))
    base = median.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "m"))), lambda s: s["m"]).alias("__base"))  # as many values as bins
    return rows.join(base, keys).withColumn("flat", F.zip_with("level", "__base", lambda x, m: x - m)).drop("__base")


def levelled(flat: Column) -> Column:
    """A spectrum without its own median."""
    return F.zip_with(flat, F.array_repeat(middle(flat), F.size(flat)), lambda x, own: x - own)  # inside a lambda the median would be taken again for each bin


def tied(x: str, y: str) -> Column:
    """Correlation over a group; 0 where either side never changes."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def windowed(rows: DataFrame, keys: Sequence[str], width: float, step: float, least: int) -> DataFrame:
    """Rows once for each sliding window that holds them, with its `start`, the row's `place` in it and how many `held` it has.

    Windows begin at every step from the first row on and one ends with the last row; rows that span no more than one
    width are one window. Windows of fewer than `least` rows are left out.
    """
    span = rows.groupBy(*keys).agg(F.min("t").alias("__a"), F.max("t").alias("__b"))
    a, b, t = F.col("__a"), F.col("__b"), F.col("t")
    count = F.ceil((b - width + step - a) / step)
    # A row looks at the few windows that begin up to one width before it, never at all of its capture.
    first, last = F.greatest(F.lit(0).cast("long"), F.floor((t - width - a) / step) - 1), F.least(count - 1, F.floor((t - a) / step) + 1)
    around = F.when(first <= last, F.transform(F.sequence(first, last), lambda i: a + i * step)).otherwise(F.array().cast("array<double>"))
    held = F.filter(F.array_union(around, F.array(b - width)), lambda s: (t >= s) & (t <= s + width))
    inside = F.explode(F.when(b - a <= width, F.array(a)).otherwise(held))
    whole = Window.partitionBy(*keys, "start")  # one window's rows
    placed = rows.join(span, list(keys)).withColumn("start", inside).drop("__a", "__b")
    return placed.withColumns({"place": F.row_number().over(whole.orderBy("t", "row")) - 1, "held": F.count("*").over(whole)}).where(F.col("held") >= least)


# --- Unknown straight drifts ------------------------------------------------------------------------------------------

SLOPES = "capture long, receiver int, start double, stop double, polarity int, slope double, peak int, frequency double, prominence double, moving double, stationary double, improvement double, false_alarm double, motion_bins int"


def prominent(profile: np.ndarray, least: float, most: int) -> list[tuple[int, float]]:
    """The most prominent local maxima of a profile and how far each stands out, the best first; its ends are none."""
    found = []
    for i in np.flatnonzero((profile[1:-1] > profile[:-2]) & (profile[1:-1] > profile[2:])) + 1:
        left, right = np.flatnonzero(profile[:i] > profile[i]), np.flatnonzero(profile[i + 1 :] > profile[i])
        a, b = left[-1] + 1 if left.size else 0, i + 1 + right[0] if right.size else profile.size
        out = profile[i] - max(profile[a : i + 1].min(), profile[i:b].min())
        if out >= least:
            found.append((int(i), float(out)))
    return sorted(found, key=lambda p: (-p[1], p[0]))[:most]


def straight_paths(window: pd.DataFrame, slopes: Sequence[float], bin_hz: float, prominence: float, most: int, permutations: int, seed: int) -> list[tuple]:
    """Peaks of one window's slope bank: chosen on even rows, scored on odd ones, beside the same bin at rest and odd rows in other orders."""
    window = window.sort_values("place")
    capture, receiver, start = int(window.capture.iloc[0]), int(window.receiver.iloc[0]), float(window.start.iloc[0])
    flat, t = np.stack(window.even.to_numpy()), window.t.to_numpy(float)
    after, bins = t - t[0], flat.shape[1]
    odd = np.arange(1, len(t), 2)
    draw = np.random.default_rng([seed, capture % 2**63, receiver, int(start * 1000) % 2**63])
    orders = [draw.permutation(odd) for _ in range(permutations)]
    out = []
    for slope in slopes:
        shift = np.rint(slope * after / bin_hz).astype(int)
        low, high = max(0, -shift.min()), min(bins, bins - shift.max())
        if high - low < 16:
            continue
        profile = flat[np.arange(0, len(t), 2)[:, None], np.arange(low, high) + shift[::2, None]].mean(axis=0)
        for sign in (1, -1):
            peaks = prominent(sign * profile, prominence, most)
            if not peaks:
                continue
            at = np.array([p for p, _ in peaks]) + low
            moving = sign * flat[odd[:, None], at + shift[odd, None]].mean(axis=0)
            rest = sign * flat[odd[:, None], at].mean(axis=0)
            nulls = np.array([(sign * (flat[o[:, None], at + shift[odd, None]] - flat[o[:, None], at])).mean(axis=0).max() for o in orders])
            for k, (_, out_by) in enumerate(peaks):
                better = moving[k] - rest[k]
                chance = (1 + int((nulls >= better).sum())) / (permutations + 1) if permutations else None
                path = at[k] + shift
                out.append((capture, receiver, start, float(t[-1]), sign, float(slope), int(at[k]), float(np.median(path)) * bin_hz, out_by, float(moving[k]), float(rest[k]), float(better), chance, int(np.ptp(path))))
    return out


def slope_search(
    rows: DataFrame, bin_hz: float, slopes: Sequence[float], width: float = 10.0, step: float = 5.0, prominence: float = 0.08,
    peaks: int = 16, permutations: int = 19, seed: int = 0, most: int = 32,
) -> DataFrame:
    """Straight drifts of unknown slope and start in either polarity, the best `most` of each receiver, with reasons against each.

    A window's even rows choose the start of a path, its odd rows score it (`moving`). Controls are the same bin at rest
    (`stationary`) and the highest gain of any start over `permutations` seeded orders of the odd rows (`false_alarm`).
    Of paths less than a step, four bins and one and a half slopes apart the qualified, then the better one stays. A task
    works on one window of one receiver. Windows of fewer than four rows, and slopes that leave less than 16 bins, have none.
    """
    flat = residuals(rows).select("capture", F.col("receiver").cast("int").alias("receiver"), "row", "t", levelled(F.col("flat")).alias("even"))
    windows = windowed(flat, ["capture", "receiver"], width, step, 4)
    names = [c.split()[0] for c in SLOPES.split(", ")]
    bank = [float(s) for s in slopes]
    search = lambda window: pd.DataFrame(straight_paths(window, bank, bin_hz, prominence, peaks, permutations, seed), columns=names)
    found = windows.groupBy("capture", "receiver", "start").applyInPandas(search, SLOPES)
    why = all_reasons(**{
        "motion below three bins": F.col("motion_bins") < 3, "does not beat stationary control": F.col("improvement") < 0.02,
        "does not beat time-scrambled control": F.coalesce(F.col("false_alarm") > 0.1, F.lit(False)), "held-out score too low": F.col("moving") < prominence / 2,
    })
    told = found.withColumn("reasons", why).withColumn("qualified", F.size("reasons") == 0).withColumn("mid", (F.col("start") + F.col("stop")) / 2)
    named = written(told.withColumn("id", F.concat_ws(":", "capture", "receiver", "start", "polarity", "slope", "peak")), "searches")
    spacing = min((abs(a - b) for a, b in zip(bank, bank[1:], strict=False)), default=1.0)
    kept = suppressed(named, "id", ["capture", "receiver"], [("mid", step), ("frequency", 4 * bin_hz), ("slope", 1.5 * spacing)], [~F.col("qualified"), -F.col("moving")], strict=True)
    best = F.row_number().over(Window.partitionBy("capture", "receiver").orderBy(F.desc("qualified"), F.desc("moving"), "id"))  # what suppression left
    return kept.withColumn("rank", best).where(F.col("rank") <= most).drop("id", "mid")


# --- Predicted paths --------------------------------------------------------------------------------------------------


def overlapping(rows: DataFrame, passes: DataFrame, least_s: float, bucket: float = 600.0) -> DataFrame:
    """Rows of captures during passes (pass, points: array<struct<t,doppler>> by time), with the predicted frequency between the points.

    Captures meet passes in buckets of time, once for a pair; a pair stays with five rows or more over `least_s`.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket))).alias("__k")
    spans = rows.groupBy("capture").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    known = passes.select("pass", "points", F.get("points", F.lit(0))["t"].alias("rise"), F.element_at("points", -1)["t"].alias("set"))
    met = spans.select("capture", "a", "b", buckets(F.col("a"), F.col("b"))).join(known.select("pass", "rise", "set", buckets(F.col("rise"), F.col("set"))), "__k")
    pairs = met.where("rise <= b AND set >= a").select("capture", "pass").distinct().join(known, "pass")
    during = rows.join(pairs, "capture").where("t BETWEEN rise AND set")
    before = F.filter("points", lambda p: p["t"] <= F.col("t"))
    p, q = F.element_at(before, -1), F.coalesce(F.get("points", F.size(before)), F.element_at("points", -1))
    share = F.when(q["t"] > p["t"], (F.col("t") - p["t"]) / (q["t"] - p["t"])).otherwise(0.0)
    inside = during.withColumn("predicted", p["doppler"] + (q["doppler"] - p["doppler"]) * share).drop("points", "rise", "set")
    long_enough = inside.groupBy("capture", "pass").agg(F.count_distinct("row").alias("n"), (F.max("t") - F.min("t")).alias("d")).where((F.col("n") >= 5) & (F.col("d") >= least_s))
    return inside.join(long_enough.select("capture", "pass"), ["capture", "pass"])


def teeth(spacing: float, bin_hz: float) -> list[int]:
    return sorted({int(np.rint(k * spacing / bin_hz)) for k in range(-4, 5)})


def path_windows(
    rows: DataFrame, passes: DataFrame, bin_hz: float, threshold: float = 0.35, spacing: float = 43_900.0, wrong: Sequence[float] = (35_000.0, 52_000.0),
    dwell: float = 30.0, step: float = 10.0, least_s: float = 8.0, broad: float = 0.2,
) -> DataFrame:
    """Every dwell window of every pass that a capture overlaps, for each model (tone, comb) and polarity, with its controls and reasons.

    A path is the predicted frequency, moved by whole bins; each receiver has a bias of its own, the one with the highest
    mean excess over the threshold. Controls: the best bin at rest, combs of wrong spacings on the same path, the share of
    rows in which both receivers are active over a wide band, and how the receivers' traces correlate. Combs are tried
    where bins are 15 kHz or less and the nine teeth differ.
    """
    flat = residuals(rows).withColumn("even", levelled(F.col("flat"))).withColumn("wide", total(F.transform("flat", lambda x: (F.abs(x) > threshold).cast("double"))) / F.size("flat"))
    during = overlapping(flat.select("capture", "receiver", "row", "t", "even", "wide"), passes, least_s)
    w = windowed(during, ["capture", "pass", "receiver"], dwell, step, 5)
    key = ["capture", "pass", "start"]
    centre = w.groupBy(*key, "receiver").agg(F.max(F.when(F.col("place") == F.floor(F.col("held") / 2), F.col("predicted"))).alias("__c"))
    moved = written(w.join(centre, [*key, "receiver"]).withColumn("shift", F.rint((F.col("predicted") - F.col("__c")) / bin_hz).cast("int")).drop("__c"), "searches")
    facts = moved.groupBy(*key, "row").agg(F.min("wide").alias("both"), F.count_distinct("receiver").alias("n"), F.first("t").alias("t"), F.first("shift").alias("shift"), F.first("predicted").alias("predicted")).where("n = 2")
    facts = facts.groupBy(*key).agg(
        F.avg((F.col("both") >= broad).cast("double")).alias("broadband"), F.count("*").alias("observations"), (F.max("t") - F.min("t")).alias("duration_s"),
        (F.max("shift") - F.min("shift")).alias("span_bins"), (F.max("predicted") - F.min("predicted")).alias("span_hz"),
    )
    models = {"tone": [0]}
    if bin_hz <= 15_000 and len(teeth(spacing, bin_hz)) == 9:
        models |= {"comb": teeth(spacing, bin_hz)} | {f"wrong{i}": teeth(x, bin_hz) for i, x in enumerate(wrong)}
    kinds = F.explode(F.array(*(F.struct(F.lit(name).alias("model"), F.array(*map(F.lit, offsets)).alias("teeth")) for name, offsets in models.items()))).alias("__m")
    each = moved.select("*", kinds).select("*", "__m.model", "__m.teeth", F.explode(F.array(F.lit(1), F.lit(-1))).alias("polarity"))
    bins = F.size("even")
    cell = lambda i: F.when((i + F.array_min("teeth") >= 0) & (i + F.array_max("teeth") < bins), F.aggregate("teeth", F.lit(0.0), lambda s, o: s + F.get("even", i + o)) * F.col("polarity") / F.sqrt(F.lit(1.0) * F.size("teeth")))
    signal = each.withColumn("signal", F.transform(F.sequence(F.lit(0), bins - 1), cell)).drop("even", "wide", "teeth", "__m")
    signal = written(signal, "searches")
    at = F.posexplode("signal").alias("base", "rest")
    long = signal.select(*key, "receiver", "model", "polarity", "held", "shift", "signal", at).withColumn("moving", F.when(F.col("base") + F.col("shift") >= 0, F.get("signal", F.col("base") + F.col("shift"))))
    held = lambda c: F.when(F.count(c) == F.max("held"), F.avg(F.when(F.col(c) > threshold, F.col(c) - threshold).when(F.col(c).isNotNull(), 0.0)))
    scores = long.groupBy(*key, "receiver", "model", "polarity", "base").agg(held("moving").alias("moving"), held("rest").alias("rest"))
    best = F.max(F.when(F.col("moving").isNotNull(), F.struct("moving", (-F.col("base")).alias("base"))))
    chosen = scores.groupBy(*key, "receiver", "model", "polarity").agg(best.alias("b"), F.max("rest").alias("stationary")).where("b IS NOT NULL")
    chosen = written(chosen.select(*key, "receiver", "model", "polarity", (-F.col("b.base")).alias("bias"), F.col("b.moving").alias("score"), "stationary"), "searches")
    controls = chosen.where("model LIKE 'wrong%'").groupBy(*key, "receiver", "polarity").agg(F.max("score").alias("wrong"))
    own = chosen.where("model IN ('tone', 'comb')").join(controls.withColumn("model", F.lit("comb")), [*key, "receiver", "model", "polarity"], "left")
    trace = signal.join(own.select(*key, "receiver", "model", "polarity", "bias"), [*key, "receiver", "model", "polarity"]).withColumn("x", F.get("signal", F.col("bias") + F.col("shift")))
    side = lambda r, c: F.max(F.when(F.col("receiver") == r, F.col(c)))
    paired = trace.groupBy(*key, "model", "polarity", "row").agg(side(0, "x").alias("x"), side(1, "x").alias("y"))
    active = lambda c: F.avg((F.col(c) > threshold).cast("double"))
    together = paired.groupBy(*key, "model", "polarity").agg(tied("x", "y").alias("correlation"), F.least(active("x"), active("y")).alias("activity"))
    joint = own.groupBy(*key, "model", "polarity").agg(
        F.count("*").alias("receivers"), F.min("score").alias("joint"), F.min(F.col("score") - F.col("stationary")).alias("improvement"), F.min(F.col("score") - F.col("wrong")).alias("comb_improvement"),
        side(0, "bias").alias("bias_0"), side(1, "bias").alias("bias_1"), side(0, "score").alias("score_0"), side(1, "score").alias("score_1"),
    ).where("receivers = 2").drop("receivers")
    why = all_reasons(**{
        "predicted Doppler unresolved": F.col("span_bins") < 3, "joint score too low": F.col("joint") < 0.05, "does not beat stationary control": F.col("improvement") < 0.03,
        "comb does not beat wrong spacings": F.coalesce(F.col("comb_improvement") < 0.03, F.lit(False)), "common broadband activity": F.col("broadband") > 0.2,
        "receivers not correlated": (F.col("correlation") < 0.5) & (F.col("activity") < 0.8),
    })
    return joint.join(facts, key).join(together, [*key, "model", "polarity"]).withColumn("reasons", why).withColumn("qualified", F.size("reasons") == 0)


def path_search(rows: DataFrame, passes: DataFrame, bin_hz: float, **how) -> DataFrame:
    """The best window, model and polarity of each capture and pass: a qualified one, else that with the highest joint score."""
    told = path_windows(rows, passes, bin_hz, **how)
    names = [c for c in told.columns if c not in ("capture", "pass")]
    rank = F.struct("qualified", "joint", "improvement", -F.col("start"), "model", "polarity")
    return told.groupBy("capture", "pass").agg(F.max_by(F.struct(*names), rank).alias("b")).select("capture", "pass", "b.*")


# --- Features that both receivers see ---------------------------------------------------------------------------------


def lagged(a: Column, b: Column, lag: Column) -> Column:
    """Correlation of the bins that two spectra share when b is moved back by lag; -1 where either does not vary."""
    n = F.size(a) - F.abs(lag)
    x, y = F.slice(a, F.greatest(F.lit(0), -lag) + 1, n), F.slice(b, F.greatest(F.lit(0), lag) + 1, n)
    names = ("x", "y", "xx", "yy", "xy")
    from_first = F.zip_with(x, y, lambda p, q: F.struct((p - F.get(a, F.lit(0))).alias("x"), (q - F.get(b, F.lit(0))).alias("y")))  # smaller squares

    def finish(s: Column) -> Column:
        xx, yy = s["xx"] - s["x"] * s["x"] / n, s["yy"] - s["y"] * s["y"] / n
        return F.when((xx > 0) & (yy > 0), (s["xy"] - s["x"] * s["y"] / n) / F.sqrt(xx * yy)).otherwise(-1.0)

    def add(s: Column, v: Column) -> Column:
        parts = (v["x"], v["y"], v["x"] * v["x"], v["y"] * v["y"], v["x"] * v["y"])
        return F.struct(*((s[name] + part).alias(name) for name, part in zip(names, parts, strict=True)))

    return F.aggregate(from_first, F.struct(*(F.lit(0.0).alias(name) for name in names)), add, finish)


def registered(a: Column, b: Column, reach: Column) -> Column:
    """(r, lag): the best correlation of two spectra and its lag, the lowest of equal ones."""
    tried = F.transform(F.sequence(-reach, reach), lambda lag: F.struct(lagged(a, b, lag).alias("r"), (-lag).alias("back")))
    best = F.array_max(tried)
    return F.struct(best["r"].alias("r"), (-best["back"]).alias("lag"))


def dual_motion(
    frames: DataFrame, key: str, cycle: str, receiver: str, spectrum: str, bin_width: float, least: float = 30_000.0, most: float = 600_000.0,
    correlation: float = 0.55, tolerance: float = 45_000.0, lag: int = 1,
) -> DataFrame:
    """Every pair of cycles at most `lag` apart that both receivers have: their displacements, score and reasons against promotion.

    A frame is one receiver's spectrum of one cycle (one row each). Pairs come from an equi join on the later cycle, so a
    frame meets `lag` others. Spectra of unequal length, or of fewer than 16 bins, are not compared.
    """
    frame = frames.where(F.col(receiver).isin(0, 1)).select(F.col(key).alias("key"), F.col(cycle).cast("long").alias("cycle"), F.col(receiver).alias("receiver"), F.col(spectrum).cast("array<double>").alias("now"))
    before = frame.select("key", "receiver", F.col("cycle").alias("previous"), F.col("now").alias("then"), F.explode(F.sequence(F.lit(1), F.lit(lag))).alias("__d")).withColumn("cycle", F.col("previous") + F.col("__d"))
    met = before.join(frame, ["key", "receiver", "cycle"]).where((F.size("then") == F.size("now")) & (F.size("now") >= 16))
    reach = F.least(F.lit(int(most // bin_width)), F.floor(F.size("now") / 4).cast("int"))
    each = met.select("key", "previous", "cycle", "receiver", registered(F.col("then"), F.col("now"), reach).alias("b"))
    side = lambda r, c: F.max(F.when(F.col("receiver") == r, F.col(c)))
    both = each.groupBy("key", "previous", "cycle").agg(
        F.count_distinct("receiver").alias("n"), (side(0, "b.lag") * bin_width).alias("shift_0"), (side(1, "b.lag") * bin_width).alias("shift_1"), side(0, "b.r").alias("correlation_0"), side(1, "b.r").alias("correlation_1"),
    ).where("n = 2").drop("n")
    apart, weaker = F.abs(F.col("shift_0") - F.col("shift_1")), F.least("correlation_0", "correlation_1")
    why = all_reasons(**{"shift": F.least(F.abs("shift_0"), F.abs("shift_1")) < least, "correlation": weaker < correlation, "disagreement": apart > tolerance})
    told = both.withColumns({"shift": (F.col("shift_0") + F.col("shift_1")) / 2, "score": weaker - apart / max(tolerance, 1.0), "reasons": why})
    return told.withColumn("promoted", F.size("reasons") == 0)


def beside(rows: DataFrame, column: str, both: bool) -> DataFrame:
    """An array of flags joined with those of the rows before and after: any of the three, or all of three rows that exist."""
    sent = rows.select("capture", "polarity", F.explode(F.array(*(F.struct((F.col("row") + d).alias("row"), F.lit(d == 0).alias("own")) for d in (-1, 0, 1)))).alias("s"), column)
    met = sent.groupBy("capture", "polarity", "s.row").agg(F.collect_list(column).alias("l"), F.bool_or("s.own").alias("own")).where("own")  # three arrays at most
    fold = F.reduce(F.slice("l", 2, 2), F.get("l", F.lit(0)), lambda x, y: F.zip_with(x, y, lambda p, q: (p & q) if both else (p | q)))
    return met.select("capture", "polarity", "row", (F.when(F.size("l") == 3, fold).otherwise(F.transform(fold, lambda x: F.lit(False))) if both else fold).alias(column))


def corrections(rows: DataFrame, reach: int) -> DataFrame:
    """(capture, receiver, row, moved, r): how many bins each row's texture lies above that of the middle row, and how well they correlate.

    Texture is a spectrum less a wide Gaussian of itself. Captures of no more than four times `reach` bins have none.
    """
    weights = kernel(20.0)
    radius = len(weights) // 2
    w, last = F.array(*map(F.lit, weights)), F.size("level") - 1
    wide = lambda i: F.aggregate(F.sequence(F.lit(-radius), F.lit(radius)), F.lit(0.0), lambda s, d: s + F.get(w, d + radius) * F.get("level", F.greatest(F.lit(0), F.least(last, i + d))))
    texture = rows.where(F.size("level") > 4 * reach).select("capture", "receiver", "row", F.transform("level", lambda x, i: x - wide(i)).alias("texture"))
    texture = written(texture, "searches")
    mid = texture.groupBy("capture", "receiver").agg(F.floor((F.max("row") + 1) / 2).alias("row"))
    reference = texture.join(mid, ["capture", "receiver", "row"]).select("capture", "receiver", F.col("texture").alias("reference"))
    found = texture.join(reference, ["capture", "receiver"]).select("capture", "receiver", "row", registered(F.col("reference"), F.col("texture"), F.lit(reach)).alias("b"))
    return found.select("capture", "receiver", "row", F.col("b.lag").alias("moved"), "b.r")


def dual_features(
    rows: DataFrame, bin_hz: float, threshold: float = 0.35, duration: tuple[float, float] = (8.0, 60.0), width: tuple[float, float] = (100_000.0, 2_000_000.0),
    margin: float = 3.0, shift_hz: float = 150_000.0,
) -> DataFrame:
    """Blocks that both receivers see beyond the threshold, of either polarity: path, width, depth and drift by receiver, and reasons against motion.

    Pixels of both receivers are closed by a 3 x 3 square and joined to components over runs of bins that overlap. The
    path of a row is its centroid within the component's bins. The global control registers each row to the middle row
    over the whole band: motion that goes once this is taken out was the receiver's own. It is null where bins are too few
    or a receiver's median correlation is below 0.4.
    """
    flat = written(residuals(rows), "searches")
    side = lambda r: F.max(F.when(F.col("receiver") == r, F.struct("flat"))).getField("flat")
    both = written(flat.groupBy("capture", "row").agg(side(0).alias("x"), side(1).alias("y"), F.min("t").alias("t")).where("x IS NOT NULL AND y IS NOT NULL"), "searches")
    mask = both.withColumn("polarity", F.explode(F.array(F.lit(1), F.lit(-1)))).select("capture", "polarity", "row", F.zip_with("x", "y", lambda p, q: (p * F.col("polarity") > threshold) & (q * F.col("polarity") > threshold)).alias("m"))
    near = lambda i, k: F.coalesce(F.when(i + k >= 0, F.get("m", i + k)), F.lit(False))
    grown = beside(mask.withColumn("m", F.transform("m", lambda x, i: near(i, -1) | x | near(i, 1))), "m", False)
    closed = beside(grown.withColumn("m", F.transform("m", lambda x, i: near(i, -1) & x & near(i, 1))), "m", True)
    runs = closed.select("capture", "polarity", "row", F.explode(stretches(F.col("m"))).alias("s")).select("capture", "polarity", "row", "s.a", "s.b")
    number = (F.col("capture") * 2 + (F.col("polarity") < 0).cast("long")) * (1 << 44) + F.col("row") * (1 << 16) + F.col("a")
    nodes = written(runs.withColumn("id", number), "searches")
    above = nodes.select("capture", "polarity", (F.col("row") + 1).alias("row"), F.col("a").alias("c"), F.col("b").alias("d"), F.col("id").alias("other"))
    edges = nodes.join(above.hint("merge"), ["capture", "polarity", "row"]).where("a <= d AND c <= b").select("id", "other")
    labels = components(edges, "id", "other")
    member = nodes.join(labels.hint("merge"), F.col("id") == F.col("node"), "left").withColumn("feature", F.coalesce("component", "id"))
    box = member.groupBy("capture", "polarity", "feature").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.min("a").alias("low"), F.max("b").alias("high"))
    times = both.select("capture", "row", "t")
    timed = box.join(times.select("capture", F.col("row").alias("first"), F.col("t").alias("t0")).hint("merge"), ["capture", "first"]).join(times.select("capture", F.col("row").alias("last"), F.col("t").alias("t1")).hint("merge"), ["capture", "last"])
    spread = (F.col("high") - F.col("low") + 1) * bin_hz
    timed = written(timed.where((F.col("t1") - F.col("t0")).between(*duration) & spread.between(*width)), "searches")
    taken = timed.withColumn("row", F.explode(F.sequence("first", "last"))).join(flat.select("capture", "receiver", "row", "t", "flat").hint("merge"), ["capture", "row"])
    part = F.transform(F.slice("flat", F.col("low") + 1, F.col("high") - F.col("low") + 1), lambda x: x * F.col("polarity"))
    weighed = taken.withColumn("v", part).withColumn("w", F.transform("v", lambda x: F.greatest(x - threshold / 2, F.lit(0.0)))).withColumn("s", total(F.col("w"))).where("s > 0")
    strong = F.filter(F.transform("w", lambda x, i: F.when(x > threshold / 2, i)), lambda i: i.isNotNull())
    centre = total(F.transform("w", lambda x, i: x * (i + F.col("low")))) / F.col("s") * bin_hz
    extent = F.when(F.size(strong) > 0, (F.array_max(strong) - F.array_min(strong) + 1) * bin_hz).otherwise(0.0)
    path = weighed.select("capture", "polarity", "feature", "receiver", "row", "t", centre.alias("raw"), extent.alias("width"), (total(F.zip_with("v", "w", lambda x, k: x * k)) / F.col("s")).alias("depth"))
    fix = corrections(rows.join(timed.select("capture").distinct(), "capture", "left_semi"), max(1, int(shift_hz / bin_hz)))
    fixed = path.join(fix.hint("merge"), ["capture", "receiver", "row"], "left").withColumn("at", F.col("raw") - F.coalesce("moved", F.lit(0)) * bin_hz)
    of = lambda r, c: F.max(F.when(F.col("receiver") == r, F.col(c)))
    columns = ("raw", "at", "width", "depth", "r", "moved")
    wide = fixed.groupBy("capture", "polarity", "feature", "row", "t").agg(*(of(r, c).alias(f"{c}_{r}") for c in columns for r in (0, 1))).where("raw_0 IS NOT NULL AND raw_1 IS NOT NULL")
    apart = F.col("at_0") - F.col("at_1")
    measures = []
    for r in (0, 1):
        ends = [f(f"at_{r}", "row") for f in (F.max_by, F.min_by)]
        measures += [F.median(f"at_{r}").alias(f"centre_{r}"), F.median(f"width_{r}").alias(f"width_{r}"), F.median(f"depth_{r}").alias(f"depth_{r}"), F.median(f"r_{r}").alias(f"registration_{r}"), (ends[0] - ends[1]).alias(f"net_{r}")]
        measures += [F.regr_slope(f"at_{r}", "t").alias(f"drift_{r}"), F.regr_slope(f"raw_{r}", "t").alias(f"raw_drift_{r}"), ((F.max(f"moved_{r}") - F.min(f"moved_{r}")) * bin_hz).alias(f"global_span_{r}")]
    measured = wide.groupBy("capture", "polarity", "feature").agg(
        F.count("*").alias("rows"), F.min("t").alias("start"), F.max("t").alias("stop"), tied("at_0", "at_1").alias("correlation"),
        F.avg(apart).alias("__m"), F.avg(apart * apart).alias("__q"), *measures,
    ).where("rows >= 5")
    offset = F.col("centre_0") - F.col("centre_1")
    rms = F.sqrt(F.greatest(F.lit(0.0), F.col("__q") - 2 * offset * F.col("__m") + offset * offset))
    available = (F.col("registration_0") >= 0.4) & (F.col("registration_1") >= 0.4)
    holds = [(F.col(f"raw_drift_{r}") * F.col(f"drift_{r}") > 0) & (F.abs(f"drift_{r}") >= 0.5 * F.abs(f"raw_drift_{r}")) for r in (0, 1)]
    whole = measured.withColumns({"path_rms_hz": rms, "global_control": F.when(available, holds[0] & holds[1])}).drop("__m", "__q")
    why = all_reasons(**{
        "paths not correlated": F.col("correlation") < 0.6, "drift directions differ": F.col("drift_0") * F.col("drift_1") <= 0, "drift rates differ": F.abs(F.col("drift_0") - F.col("drift_1")) > 1000,
        "paths more than six bins apart": F.col("path_rms_hz") > 6 * bin_hz, "motion is the receiver's own": F.coalesce(~F.col("global_control"), F.lit(False)),
    })
    ends = rows.groupBy("capture").agg(F.min("t").alias("__a"), F.max("t").alias("__b"))
    cut = all_reasons(**{"onset cut off": F.col("start") - F.col("__a") < margin, "ending cut off": F.col("__b") - F.col("stop") < margin})
    boxed = whole.join(timed.select("feature", "capture", ((F.col("high") - F.col("low") + 1) * bin_hz).alias("bounding_hz")).hint("merge"), ["capture", "feature"]).join(ends, "capture")
    return boxed.withColumns({"reasons": why, "warnings": cut}).withColumn("qualified", F.size("reasons") == 0).drop("__a", "__b")
