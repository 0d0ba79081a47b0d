"""Events in waterfalls: smoothed residuals of either polarity, cut into runs of bins, joined into components, measured along their paths.

A spectrum is one array of a row; what concerns neighbouring bins is done inside
the array. Rows meet their neighbours by equi joins on the row's number, by sort and merge (none is sent through the driver), each
sending its weighted share to the rows within the kernel's radius. Components
are made of runs (first and last bin of a stretch above the threshold in one
row), not of pixels, so their graph has a node for each stretch.

Captures are whole numbers, rows are numbered from 0 without gaps, and all
spectra of a capture have the same number of bins, below 65,536.
"""

from __future__ import annotations

from functools import reduce
from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.graph import components
from orrery.sources.scratch import written

#: Standard deviations at which the kernel is cut off.
CUT = 4


def kernel(sigma: float) -> list[float]:
    """Weights of a Gaussian from -radius to radius, which sum to 1."""
    radius = int(CUT * sigma + 0.5)
    raw = [exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)] if sigma > 0 else [1.0]
    return [x / sum(raw) for x in raw]


def residuals(spectra: DataFrame, capture: str, row: str, level: str) -> DataFrame:
    """(capture, row, flat): spectra without each bin's median over the capture's rows."""
    long = spectra.select(F.col(capture).cast("long").alias("capture"), F.col(row).cast("long").alias("row"), F.posexplode(level).alias("bin", "level"))
    median = long.groupBy("capture", "bin").agg(F.median(F.col("level").cast("double")).alias("m"))
    base = median.groupBy("capture").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "m"))), lambda x: x["m"]).alias("base"))  # as many values as bins
    own = spectra.select(F.col(capture).cast("long").alias("capture"), F.col(row).cast("long").alias("row"), F.col(level).alias("level"))
    return own.join(base, "capture").select("capture", "row", F.zip_with("level", "base", lambda x, m: x.cast("double") - m).alias("flat"))


def smoothed(rows: DataFrame, sigma: tuple[float, float]) -> DataFrame:
    """(capture, row, flat, smooth): a Gaussian over rows and bins; beyond an edge its value goes on."""
    over_rows, over_bins = kernel(sigma[0]), kernel(sigma[1])
    r, b = len(over_rows) // 2, len(over_bins) // 2
    last = F.size("flat") - 1
    at = lambda i: F.get("flat", F.greatest(F.lit(0), F.least(last, i)))
    along = F.transform(F.sequence(F.lit(0), last), lambda i: sum((at(i + d) * w for d, w in zip(range(-b, b + 1), over_bins, strict=True)), F.lit(0.0)))
    ends = rows.groupBy("capture").agg(F.max("row").alias("__last"))
    sent = rows.select("capture", "row", along.alias("v")).join(ends, "capture")
    # What a row gives to the row i away: its weight, and at either end the weights of all that would lie beyond.
    weights = F.array(*map(F.lit, over_rows))
    tail = [sum(over_rows[k:]) for k in range(len(over_rows))]
    head = [sum(over_rows[: k + 1]) for k in range(len(over_rows))]
    step = F.explode(F.sequence(F.lit(-r), F.lit(r))).alias("d")
    given = sent.select("*", step).withColumn("to", F.col("row") - F.col("d")).where((F.col("to") >= 0) & (F.col("to") <= F.col("__last")))
    k = F.col("d") + r
    first, final = F.col("row") == 0, F.col("row") == F.col("__last")
    weight = F.when(first & final, F.lit(1.0)).when(first, F.get(F.array(*map(F.lit, head)), k)).when(final, F.get(F.array(*map(F.lit, tail)), k)).otherwise(F.get(weights, k))
    long = given.select("capture", F.col("to").alias("row"), weight.alias("w"), F.posexplode("v").alias("bin", "x"))
    summed = long.groupBy("capture", "row", "bin").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    whole = summed.groupBy("capture", "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "x"))), lambda x: x["x"]).alias("smooth"))
    return rows.join(whole.hint("merge"), ["capture", "row"])


def stretches(mask: Column) -> Column:
    """First and last place of each run of true values."""
    n = F.size(mask)
    places = F.sequence(F.lit(0), n - 1)
    on = lambda i: F.coalesce(F.get(mask, i), F.lit(False))
    starts = F.filter(places, lambda i: on(i) & ~on(i - 1))
    ends = F.filter(places, lambda i: on(i) & ~on(i + 1))
    return F.when(n > 0, F.arrays_zip(starts.alias("a"), ends.alias("b"))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def runs(rows: DataFrame, threshold: float) -> DataFrame:
    """(capture, polarity, row, flat, a, b): stretches at or beyond the threshold, after gaps that a 2 x 2 square cannot enter are closed."""
    both = rows.withColumn("polarity", F.explode(F.array(F.lit(1), F.lit(-1))))
    # A place below or left of one beyond the threshold, in one more bin than there are.
    grown = F.transform(F.sequence(F.lit(0), F.size("smooth")), lambda i: F.greatest(F.coalesce(F.get("smooth", i), F.lit(float("-inf"))), F.coalesce(F.get("smooth", i - 1), F.lit(float("-inf")))) >= threshold)
    signed = both.withColumn("smooth", F.transform("smooth", lambda x: x * F.col("polarity")))
    marked = written(signed.select("capture", "polarity", "row", "flat", grown.alias("m")), "events")
    near = lambda d, name: marked.select("capture", "polarity", (F.col("row") + d).alias("row"), F.col("m").alias(name))
    joined = marked.join(near(1, "before").hint("merge"), ["capture", "polarity", "row"], "left").join(near(-1, "after").hint("merge"), ["capture", "polarity", "row"], "left")
    none = F.transform("m", lambda x: F.lit(False))
    here = F.zip_with("m", F.coalesce("before", none), lambda x, y: x | y)
    there = F.zip_with(F.coalesce("after", none), "m", lambda x, y: x | y)
    full = F.zip_with(here, there, lambda x, y: x & y)
    closed = F.transform(F.sequence(F.lit(0), F.size("m") - 2), lambda i: F.get(full, i) & F.get(full, i + 1))
    found = joined.select("capture", "polarity", "row", "flat", closed.alias("c"))
    return found.select("capture", "polarity", "row", "flat", F.explode(stretches(F.col("c"))).alias("s")).select("capture", "polarity", "row", "flat", "s.a", "s.b")


def segmented(
    spectra: DataFrame, capture: str, row: str, level: str, threshold: float, sigma: tuple[float, float] = (1.0, 1.0),
    least: tuple[int, int, int] = (3, 3, 12), broad: float = 0.65,
) -> tuple[DataFrame, DataFrame]:
    """Events (capture, polarity, event, start, stop, low, high, pixels, bandwidth, peak, occupancy, broadband) and their paths (capture, polarity, event, row, centroid, low, high).

    `least` is rows, bins and pixels that an event has at least. The centroid of a row is weighed by its residuals, the
    bandwidth is the median of the rows' extents, occupancy the median share of a row's bins.
    """
    found = runs(smoothed(residuals(spectra, capture, row, level), sigma), threshold)
    number = (F.col("capture") * 2 + (F.col("polarity") < 0).cast("long")) * (1 << 44) + F.col("row") * (1 << 16) + F.col("a")
    nodes = written(found.withColumn("id", number), "events")
    light = nodes.select("capture", "polarity", "row", "a", "b", "id")
    above = light.select("capture", "polarity", (F.col("row") + 1).alias("row"), F.col("a").alias("c"), F.col("b").alias("d"), F.col("id").alias("other"))
    touching = light.join(above.hint("merge"), ["capture", "polarity", "row"]).where((F.col("a") <= F.col("d") + 1) & (F.col("c") <= F.col("b") + 1))
    labels = components(touching.select("id", "other"), "id", "other")
    whole = nodes.join(labels.hint("merge"), F.col("id") == F.col("node"), "left").withColumn("event", F.coalesce("component", "id"))
    places = F.sequence("a", "b")
    value = lambda i: F.get("flat", i) * F.col("polarity")
    weight = lambda i: F.greatest(value(i), F.lit(2.220446049250313e-16))
    total = lambda f: F.aggregate(F.transform(places, f), F.lit(0.0), lambda s, x: s + x)
    part = whole.select("capture", "polarity", "event", "row", "a", "b", F.size("flat").alias("bins"), total(weight).alias("w"), total(lambda i: weight(i) * i).alias("wf"), F.array_max(F.transform(places, value)).alias("top"))
    path = part.groupBy("capture", "polarity", "event", "row").agg(
        (F.sum("wf") / F.sum("w")).alias("centroid"), F.min("a").alias("low"), F.max("b").alias("high"), F.sum(F.col("b") - F.col("a") + 1).alias("pixels"), F.max("top").alias("top"), F.max("bins").alias("bins"),
    )
    path = written(path, "events")
    events = path.groupBy("capture", "polarity", "event").agg(
        F.min("row").alias("start"), F.max("row").alias("stop"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("pixels").alias("pixels"),
        F.median(F.col("high") - F.col("low") + 1).alias("bandwidth"), F.max("top").alias("peak"), (F.median("pixels") / F.max("bins")).alias("occupancy"),
    ).withColumn("broadband", F.col("occupancy") >= broad)
    large = reduce(lambda x, y: x & y, [F.col("stop") - F.col("start") + 1 >= least[0], F.col("high") - F.col("low") + 1 >= least[1], F.col("pixels") >= least[2]])
    events = events.where(large)
    return events, path.join(events.select("event").hint("merge"), "event", "left_semi").select("capture", "polarity", "event", "row", "centroid", "low", "high")


def candidates(events: DataFrame, path: DataFrame, row_s: float, bin_hz: float, least_s: float = 2.0, drift: tuple[float, float] = (250.0, 15_000.0), most: int = 64) -> DataFrame:
    """The best events of each capture as tracks, with their drift by regression and why they are not qualified, if they are not.

    An event in one row is none. Qualified ones come first, then those with the higher peak, then the longer ones.
    """
    from orrery.operators.currency import all_reasons

    fitted = path.groupBy("event").agg((F.regr_slope("centroid", "row") * bin_hz / row_s).alias("drift_hz_s"), F.count("*").alias("rows")).where("rows >= 2")
    rows = events.join(fitted.hint("merge"), "event").withColumn("duration_s", (F.col("stop") - F.col("start")) * row_s)
    why = all_reasons(**{"broadband": F.col("broadband"), "duration": F.col("duration_s") < least_s, "drift": ~F.abs("drift_hz_s").between(*drift)})
    told = rows.withColumn("reasons", why).withColumn("qualified", F.size("reasons") == 0)
    place = F.row_number().over(Window.partitionBy("capture").orderBy(F.desc("qualified"), F.desc("peak"), F.desc("duration_s"), "event"))  # a row for each event
    return told.withColumn("place", place).where(F.col("place") <= most)
