"""SP: searches with controls. A capture is a label; its vectors are taken by turns as spectra of receivers 0 and 1, a second apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import profiles, searches
from orrery.plans.registry import Tables, query
from orrery.plans.spectral_queries import LONG, waterfall

BIN_HZ = 2000.0


def receivers(t: Tables) -> DataFrame:
    row = F.floor(F.col("rw") / 2)
    return waterfall(t).select(F.col("label").cast("long").alias("capture"), (F.col("rw") % 2).cast("int").alias("receiver"), row.alias("row"), row.cast("double").alias("t"), F.col("embedding").cast("array<double>").alias("level"))


@query("sp07_drift_search")
def sp07(t: Tables) -> DataFrame:
    """Straight drifts with held-out, stationary and scrambled controls; no SQL: tests hold scores against loops and planted drifts."""
    found = searches.slope_search(receivers(t), BIN_HZ, [k * 500.0 for k in range(-8, 9)], width=16.0, step=8.0)
    return found.select("capture", "receiver", "start", "stop", "polarity", "slope", "peak", "prominence", "moving", "stationary", "false_alarm", "qualified", "rank", F.array_join("reasons", ",").alias("reasons"))


@query("sp09_predicted_paths")
def sp09(t: Tables) -> DataFrame:
    """Each nation's pass on each capture's waterfall: best window with controls and reasons; no SQL: tests hold every window against numpy."""
    k = F.col("n_nationkey")
    point = lambda after, hz: F.struct((k % 9 + after).cast("double").alias("t"), (hz - 400.0 * (k % 11)).alias("doppler"))
    passes = t.nation.select(k.alias("pass"), F.array(point(0, 16_000.0), point(9, 3_000.0), point(24, -14_000.0)).alias("points"))
    best = searches.path_search(receivers(t), passes, BIN_HZ, threshold=0.05, spacing=14_000.0, wrong=(10_000.0, 12_000.0), dwell=16.0, step=4.0)
    return best.select("capture", "pass", "start", "model", "polarity", "bias_0", "bias_1", "joint", "improvement", "comb_improvement", "correlation", "activity", "broadband", "span_bins", "observations", "qualified", F.array_join("reasons", ",").alias("reasons"))


@query("sp13_receiver_features")
def sp13(t: Tables) -> DataFrame:
    """Blocks that both receivers see, with drift by receiver and the global control; no SQL: tests hold them against planted blocks."""
    found = searches.dual_features(receivers(t), BIN_HZ, threshold=0.02, duration=(1.0, 60.0), width=(2_000.0, 120_000.0), shift_hz=8_000.0)
    return found.select("capture", "polarity", "start", "stop", "rows", "bounding_hz", "drift_0", "drift_1", "width_0", "width_1", "depth_0", "depth_1", "correlation", "path_rms_hz", "global_control", "qualified", *(F.array_join(c, ",").alias(c) for c in ("reasons", "warnings")))


@query("sp06_dual_motion", f"""WITH {LONG}, s AS (SELECT a.label AS key, a.rw // 2 AS previous, b.rw // 2 AS cycle, a.rw % 2 AS receiver, d AS lag, corr(a.level, b.level) AS r FROM l a, (SELECT unnest(range(-16, 17)) AS d), l b WHERE b.label = a.label AND b.rw IN (a.rw + 2, a.rw + 4) AND b.bin = a.bin + d GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY key, previous, cycle, receiver ORDER BY r DESC, lag) AS k FROM s), e AS (SELECT key, previous, cycle, max(lag) FILTER (receiver = 0) AS a, max(lag) FILTER (receiver = 1) AS b, max(r) FILTER (receiver = 0) AS ra, max(r) FILTER (receiver = 1) AS rb FROM k WHERE k = 1 GROUP BY ALL HAVING count(*) = 2),
w AS (SELECT *, CASE WHEN least(abs(a), abs(b)) < 2 THEN 'shift' END AS x, CASE WHEN least(ra, rb) < 0.3 THEN 'correlation' END AS y, CASE WHEN abs(a - b) > 4 THEN 'disagreement' END AS z FROM e)
SELECT key, previous, cycle, a::DOUBLE AS shift_0, b::DOUBLE AS shift_1, round(ra, 9) AS correlation_0, round(rb, 9) AS correlation_1, (a + b) / 2.0::DOUBLE AS shift, round(least(ra, rb) - abs(a - b) / 4.0::DOUBLE, 9) AS score, concat_ws(',', x, y, z) AS reasons, x IS NULL AND y IS NULL AND z IS NULL AS promoted FROM w""")
def sp06(t: Tables) -> DataFrame:
    told = searches.dual_motion(receivers(t), "capture", "row", "receiver", "level", 1.0, least=2.0, most=16.0, correlation=0.3, tolerance=4.0, lag=2)
    return told.select("key", "previous", "cycle", "shift_0", "shift_1", "shift", *(F.round(c, 9).alias(c) for c in ("correlation_0", "correlation_1", "score")), F.array_join("reasons", ",").alias("reasons"), "promoted")


@query("sp05_baseline_novelty")
def sp05(t: Tables) -> DataFrame:
    """Each capture against the baseline of all: registration, trend removal and strongest bins; no SQL: tests hold it against numpy."""
    rows = receivers(t)
    found = profiles.novelty(rows, profiles.baselines(rows), threshold=0.2, trend=20.0, reach=8)
    return found.select("capture", "receiver", "coverage", "lag", *(F.round(c, 9).alias(c) for c in ("registration", "median_abs", "p99_abs", "positive", "negative")), F.array_join(F.transform("strongest", lambda b: b.cast("string")), ",").alias("strongest"))


@query("sp15_edge_tracks")
def sp15(t: Tables) -> DataFrame:
    """Drift of centre and edges in sliding windows with width, slope and linearity controls; no SQL: tests hold it against numpy."""
    found = profiles.edges(receivers(t), BIN_HZ, 16.0, 8.0, least_hz=20_000.0)
    return found.select("capture", "receiver", "start", "rows", "centre_drift", "low_drift", "high_drift", "strength", "width_hz", "motion_bins", "linearity_bins", "width_spread", "edge_difference", "qualified", F.array_join("reasons", ",").alias("reasons"))
