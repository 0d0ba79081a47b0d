"""Which predicted passes an event's points may belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators import joins


def line_at(t: Column) -> Column:
    """The line through a pass's nodes (t0, y0), (t1, y1), (t2, y2) at a time inside it."""
    rising, falling = F.col("t1") - F.col("t0"), F.col("t2") - F.col("t1")
    first = F.col("y0") + (F.col("y1") - F.col("y0")) * (t - F.col("t0")) / F.nullif(rising, F.lit(0.0))
    then = F.col("y1") + (F.col("y2") - F.col("y1")) * (t - F.col("t1")) / F.nullif(falling, F.lit(0.0))
    return F.when((t <= F.col("t1")) & (rising > 0), first).when(falling > 0, then).otherwise(F.col("y1"))


def pass_hypotheses(points: DataFrame, passes: DataFrame, keys: Sequence[str], event: str, width: float, residual_scale: float, drift_scale: float, least_overlap: float = 0.25, ambiguity: float = 1.5, most: int = 10) -> DataFrame:
    """The passes that an event's points may belong to, best first, with the event's class.

    `points` has the keys, the event and (t, y); `passes` has the keys, `pass`, three nodes (t0, y0), (t1, y1), (t2, y2)
    in order of time, and an elevation. A pass is a hypothesis if it holds three points and `least_overlap` of the
    event's. Bias is the median of what the points are above the line through the nodes, rms what remains, and
    drift_difference that of the two slopes. An event of three points or more without hypotheses is one row of nulls;
    the best score below 0.05 makes it unmatched, one within `ambiguity` of the next makes it ambiguous. Null values
    are no points. Ties go to the smaller pass; a group holds one event's points in one pass.
    """
    points = points.where("t is not null and y is not null")
    by = [*keys, event]
    events = points.groupBy(*by).agg(F.count("*").alias("total")).where("total >= 3")
    met = joins.contained(points, passes, keys, "t", "t0", "t2", width).withColumn("e", line_at(F.col("t")))
    met = met.withColumns({"r": F.col("y") - F.col("e"), "x": F.col("t") - F.col("t0")})
    fits = met.groupBy(*by, "pass").agg(
        F.count("*").alias("n"), F.median("r").alias("bias"), F.avg("r").alias("mean"), F.var_pop("r").alias("spread"),
        F.abs(F.regr_slope("y", "x") - F.regr_slope("e", "x")).alias("drift_difference"), F.max("elevation").alias("elevation"),
    )
    rms = F.sqrt(F.col("spread") + (F.col("mean") - F.col("bias")) * (F.col("mean") - F.col("bias")))
    held = fits.where("n >= 3").join(events, by).withColumns({"overlap": F.col("n") / F.col("total"), "rms": rms}).where(F.col("overlap") >= least_overlap)
    height = 0.5 + 0.5 * F.least(F.lit(1.0), F.col("elevation") / 45)
    drift = F.coalesce("drift_difference", F.lit(0.0))
    scored = held.withColumn("score", F.col("overlap") * height * F.exp(-F.col("rms") / residual_scale) * F.exp(-drift / drift_scale))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "pass")
    ranked = scored.withColumns({"rank": F.row_number().over(order), "second": F.lead("score").over(order)}).where(F.col("rank") <= most)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, second = F.first("score").over(whole), F.first("second").over(whole)
    kind = F.when(best < 0.05, "unmatched").when(best / F.greatest(second, F.lit(1e-12)) < ambiguity, "ambiguous").otherwise("ranked")
    kind = F.when(second.isNull() & (best >= 0.05), "ranked").otherwise(kind)
    found = ranked.withColumn("kind", kind).select(*by, "pass", "rank", "overlap", "bias", "rms", "drift_difference", "score", "kind")
    return events.select(*by).join(found, by, "left").withColumn("kind", F.coalesce("kind", F.lit("unmatched")))


def rate_matches(tracks: DataFrame, passes: DataFrame, keys: Sequence[str], event: str, width: float, steepest: float, decisive: float = 0.15) -> DataFrame:
    """The passes that a joint track overlaps, ranked by how well their rates agree; biases play no part.

    `tracks` has the keys, the event, its span (a, b) and its drift; `passes` as for pass_hypotheses. A pass's rate is
    that of its line between the ends of the overlap. Confidence is the share of the track that the pass covers times
    exp(-difference / steepest). Only a first match within `steepest` whose confidence leads by `decisive` qualifies;
    one without a rival leads by all of it. Tracks without length or drift, and tracks that no pass overlaps, have no
    row; ties go to the smaller pass.
    """
    met = joins.overlapping(tracks.where("b > a and drift is not null"), passes, keys, ("a", "b"), ("t0", "t2"), width)
    met = met.withColumns({"from": F.greatest("a", "t0"), "to": F.least("b", "t2")}).where(F.col("to") > F.col("from"))
    rate = (line_at(F.col("to")) - line_at(F.col("from"))) / (F.col("to") - F.col("from"))
    met = met.withColumns({"predicted": rate, "overlap": (F.col("to") - F.col("from")) / (F.col("b") - F.col("a"))})
    met = met.withColumn("difference", F.abs(F.col("drift") - F.col("predicted")))
    met = met.withColumns({"confidence": F.col("overlap") * F.exp(-F.col("difference") / steepest), "compatible": F.col("difference") <= steepest})
    order = Window.partitionBy(*keys, event).orderBy(F.desc("confidence"), "pass")
    fitting = F.count(F.when(F.col("compatible"), 1)).over(Window.partitionBy(*keys, event))
    lead = F.col("confidence") - F.coalesce(F.lead("confidence").over(order), F.lit(0.0))
    ranked = met.withColumns({"rank": F.row_number().over(order), "lead": lead, "compatible_passes": fitting})
    margin = F.when(F.col("rank") == 1, F.col("lead"))
    qualified = (F.col("rank") == 1) & F.col("compatible") & (F.col("lead") >= decisive)
    return ranked.select(*keys, event, "pass", "rank", "drift", "predicted", "overlap", "confidence", "compatible", "compatible_passes", margin.alias("margin"), qualified.alias("qualified"))
