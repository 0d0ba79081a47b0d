"""Searches with controls: planted drifts, paths and features, and numpy written out."""

from __future__ import annotations

import numpy as np
import pytest

from orrery.operators import searches
from orrery.streaming.spectra import displacement

SCHEMA = "capture long, receiver int, row long, t double, level array<double>"


def frame(spark, captures, row_s=1.0):
    rows = [(c, r, i, i * row_s, x.tolist()) for c, both in captures.items() for r, psd in enumerate(both) for i, x in enumerate(psd)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def noise(seed, rows, bins, scale=0.1):
    return np.random.default_rng(seed).normal(0, scale, (2, rows, bins))


# --- slopes ---


def drifting(seed=3):
    """Capture 1: a drift of 2 bins a second in receiver 0 and a line at rest in receiver 1; capture 2: noise."""
    one, two = noise(seed, 24, 96), noise(seed + 1, 24, 96)
    for i in range(24):
        one[0, i, 20 + 2 * i] += 3.0
        if i % 3:
            one[1, i, 40] += 3.0
    return {1: one, 2: two}


def test_drift_is_found_and_controls_refuse_the_rest(spark):
    df = frame(spark, drifting())
    slopes = [k * 500.0 for k in range(-8, 9)]
    found = searches.slope_search(df, 1000.0, slopes, width=12.0, step=6.0, prominence=0.3).collect()
    good = [r for r in found if r.qualified]
    hit = [r for r in good if (r.capture, r.receiver) == (1, 0)]
    assert hit and hit[0].rank == 1
    for r in [x for x in hit if x.moving > 2]:
        assert r.polarity == 1 and abs(r.slope - 2000) <= 500 and r.improvement > 1 and r.false_alarm <= 0.1
    windows = {r.start for r in hit if r.moving > 2}
    assert windows == {0.0, 6.0, 11.0}  # and the last window ends with the last row
    assert not [r for r in good if r.capture == 1 and r.receiver == 1 and r.moving > 1]
    rest = [r for r in found if r.slope == 0]
    assert rest and all("motion below three bins" in r.reasons for r in rest)
    # No two that are kept conflict.
    for a in found:
        for b in found:
            if a is not b and (a.capture, a.receiver) == (b.capture, b.receiver):
                mid = abs((a.start + a.stop) / 2 - (b.start + b.stop) / 2)
                assert mid >= 6.0 or abs(a.frequency - b.frequency) >= 4000 or abs(a.slope - b.slope) > 500
    again = searches.slope_search(df.repartition(2), 1000.0, slopes, width=12.0, step=6.0, prominence=0.3).collect()
    key = lambda r: (r.capture, r.receiver, r.start, r.slope, r.peak, r.polarity, r.false_alarm)
    assert sorted(map(key, again)) == sorted(map(key, found))


def test_slope_scores_against_loops(spark):
    psd = drifting(11)
    got = searches.slope_search(frame(spark, psd), 1000.0, [1000.0, 2000.0, 3000.0], width=12.0, step=6.0, prominence=0.3, permutations=0, most=10_000).collect()
    assert got
    for r in got:
        flat = psd[r.capture][r.receiver]
        flat = flat - np.median(flat, axis=0)
        flat = flat - np.median(flat, axis=1, keepdims=True)
        inside = [i for i in range(24) if r.start <= i <= r.start + 12]
        odd = [i for k, i in enumerate(inside) if k % 2]
        moving = np.mean([r.polarity * flat[i, r.peak + round(r.slope * (i - inside[0]) / 1000)] for i in odd])
        rest = np.mean([r.polarity * flat[i, r.peak] for i in odd])
        assert (r.moving, r.stationary, r.improvement) == pytest.approx((moving, rest, moving - rest)) and r.false_alarm is None


def test_prominence():
    assert searches.prominent(np.array([0.0, 3, 1, 2, 0.5, 5, 4]), 0.5, 9) == [(1, 2.5), (3, 1.0), (5, 1.0)]
    assert searches.prominent(np.array([0.0, 3, 1, 2, 0.5, 5, 4]), 0.5, 2) == [(1, 2.5), (3, 1.0)]


# --- predicted paths ---


def brute_paths(psd, t, points, bin_hz, threshold, spacing, wrong, dwell, step):
    raw = psd - np.median(psd, axis=1, keepdims=True)
    wide = np.mean(np.abs(raw) > threshold, axis=2)
    even = raw - np.median(raw, axis=2, keepdims=True)
    bins = psd.shape[2]
    inside = [i for i in range(len(t)) if points[0][0] <= t[i] <= points[-1][0]]
    a, b = t[inside[0]], t[inside[-1]]
    starts = [a] if b - a <= dwell else sorted({*np.arange(a, b - dwell + step, step), b - dwell})
    out = {}
    for start in starts:
        rows = inside if b - a <= dwell else [i for i in inside if start <= t[i] <= start + dwell]
        if len(rows) < 5:
            continue
        predicted = np.interp(t[rows], [p[0] for p in points], [p[1] for p in points])
        shift = np.rint((predicted - predicted[len(rows) // 2]) / bin_hz).astype(int)

        def best(values, low, high):
            found = (-1.0, None, None)
            for base in range(bins):
                at = base + shift
                if at.min() < low or at.max() >= bins - high:
                    continue
                trace = values[np.arange(len(rows)), at]
                score = np.maximum(trace - threshold, 0).mean()
                if score > found[0]:
                    found = (score, base, trace)
            rest = max(np.maximum(values[:, k] - threshold, 0).mean() for k in range(low, bins - high))
            return *found, rest

        def comb(values, gap):
            o = searches.teeth(gap, bin_hz)
            full = np.full_like(values, np.nan)
            for k in range(-o[0], bins - o[-1]):
                full[:, k] = values[:, [k + x for x in o]].sum(axis=1) / 3
            return full, -o[0], o[-1]

        for sign in (1, -1):
            models = {"tone": [(sign * even[r][rows], 0, 0) for r in (0, 1)], "comb": [comb(sign * even[r][rows], spacing) for r in (0, 1)]}
            for model, parts in models.items():
                sides = [best(*p) for p in parts]
                if any(s[1] is None for s in sides):
                    continue
                x, y = sides[0][2], sides[1][2]
                r = np.corrcoef(x, y)[0, 1] if np.ptp(x) and np.ptp(y) else 0.0
                gain = None
                if model == "comb":
                    others = [max(best(*comb(sign * even[k][rows], gap))[0] for gap in wrong) for k in (0, 1)]
                    gain = min(s[0] - o for s, o in zip(sides, others, strict=True))
                out[round(float(start), 6), model, sign] = (
                    min(s[0] for s in sides), min(s[0] - s[3] for s in sides), gain, sides[0][1], sides[1][1], r, min(np.mean(x > threshold), np.mean(y > threshold)),
                    np.mean(np.all(wide[:, rows] >= 0.2, axis=0)), int(np.ptp(shift)), len(rows),
                )
    return out


POINTS = [(4.0, 30_000.0), (20.0, 2_000.0), (44.0, -34_000.0)]


def passing():
    psd, t = noise(5, 48, 110), np.arange(48.0)
    at = np.rint((np.interp(t, [p[0] for p in POINTS], [p[1] for p in POINTS])) / 2000).astype(int)
    for i in range(48):
        level = 1.5 + np.sin(i)
        psd[0, i, 40 + at[i]] += level
        psd[1, i, 60 + at[i]] += level
    return psd, t


def test_paths_against_numpy(spark):
    psd, t = passing()
    df = frame(spark, {7: psd})
    passes = spark.createDataFrame([("p", POINTS), ("late", [(900.0, 0.0), (950.0, 1.0)]), ("short", [(2.0, 0.0), (7.0, 1.0)])], "pass string, points array<struct<t:double,doppler:double>>")
    how = {"threshold": 0.35, "spacing": 16_000.0, "wrong": (12_000.0, 20_000.0), "dwell": 20.0, "step": 8.0}
    got = searches.path_windows(df, passes, 2000.0, **how).collect()
    assert {r["pass"] for r in got} == {"p"}
    want = brute_paths(psd, t, POINTS, 2000.0, **how)
    mine = {(round(r.start, 6), r.model, r.polarity): r for r in got}
    assert set(mine) == set(want) and len(want) >= 12
    for k, w in want.items():
        r = mine[k]
        assert (r.bias_0, r.bias_1, r.span_bins, r.observations) == (w[3], w[4], w[8], w[9])
        assert (r.joint, r.improvement, r.correlation, r.activity, r.broadband) == pytest.approx((w[0], w[1], w[5], w[6], w[7]), abs=1e-9)
        assert (r.comb_improvement is None) == (w[2] is None) and (w[2] is None or r.comb_improvement == pytest.approx(w[2], abs=1e-9))
    best = searches.path_search(df, passes, 2000.0, **how).collect()
    assert len(best) == 1 and best[0].qualified and (best[0].model, best[0].polarity) == ("tone", 1) and best[0].bias_1 - best[0].bias_0 == 20
    # The same lines at rest do not beat the stationary control; one receiver alone has no joint score.
    still = noise(6, 48, 110)
    still[:, ::2, 50] += 2.0
    single = psd.copy()
    single[1] = noise(8, 48, 110)[1]
    for other, reason in ((still, "does not beat stationary control"), (single, "joint score too low")):
        told = searches.path_search(frame(spark, {7: other}), passes, 2000.0, **how).collect()
        assert len(told) == 1 and not told[0].qualified and reason in told[0].reasons
    assert searches.path_search(df.limit(0), passes, 2000.0).count() == 0


# --- both receivers ---


def blocks():
    """1: both receivers see a moving block; 2: only receiver 0; 3: they move apart; 4: the whole band moves with it."""
    out = {c: noise(20 + c, 60, 160, 0.03) for c in (1, 2, 3, 4)}
    texture = np.random.default_rng(9).normal(0, 1.5, 400)
    for c, psd in out.items():
        for i in range(60):
            for r in (0, 1):
                drift = i // 2 if c == 4 else 0
                psd[r, i] += texture[100 - drift : 260 - drift]
        for i in range(15, 40):
            for r in (0, 1):
                if c == 2 and r == 1 or c == 4:
                    continue
                at = (60 + (i - 15) // 2) if c != 3 or r == 0 else (60 - (i - 15) // 4)
                psd[r, i, at : at + 20] += 2.0
    return out


def test_dual_features_and_reasons(spark):
    psd = blocks()
    got = searches.dual_features(frame(spark, {c: psd[c] for c in (1, 2, 3)}), 10_000.0, threshold=0.8, shift_hz=50_000.0).collect()
    by = {}
    for r in got:
        by.setdefault(r.capture, []).append(r)
    assert 2 not in by  # one receiver alone
    moving = max(by[1], key=lambda r: r.rows)
    assert moving.qualified and moving.polarity == 1 and moving.global_control and moving.warnings == []
    flat = psd[1] - np.median(psd[1], axis=1, keepdims=True)
    for r in (0, 1):
        assert moving[f"drift_{r}"] == pytest.approx(5000, rel=0.15) and moving[f"width_{r}"] == pytest.approx(200_000, rel=0.2)
    assert (moving.start, moving.stop) == (15.0, 39.0)
    # The path and depth of receiver 0 by loops.
    low, high = 60, 60 + 12 + 19
    path = []
    for i in range(15, 40):
        w = np.maximum(flat[0, i, low : high + 1] - 0.4, 0)
        path.append((w * np.arange(low, high + 1)).sum() / w.sum() * 10_000)
    assert moving.bounding_hz == (high - low + 1) * 10_000
    assert moving.raw_drift_0 == pytest.approx(np.polyfit(np.arange(15, 40), path, 1)[0])
    apart = max(by[3], key=lambda r: r.rows)
    assert not apart.qualified and "drift directions differ" in apart.reasons
    assert searches.dual_features(frame(spark, {1: psd[1]}).limit(0), 10_000.0).count() == 0


def test_motion_of_the_whole_band_is_the_receivers_own(spark):
    psd = blocks()[4]
    fix = {(r.receiver, r.row): (r.moved, r.r) for r in searches.corrections(frame(spark, {4: psd}), 12).collect()}
    for r in (0, 1):
        assert [fix[r, i][0] for i in range(10, 50)] == [i // 2 - 15 for i in range(10, 50)]
        assert min(fix[r, i][1] for i in range(10, 50)) > 0.9
    assert searches.corrections(frame(spark, {4: psd}), 60).count() == 0


def test_dual_motion_against_loops(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(0, 1, 80)
    rows, spectra = [], {}
    for key in ("a", "b", "c"):
        for cycle in range(5):
            for r in (0, 1):
                move = {"a": 3 * cycle, "b": 3 * cycle * (1 if r else -1), "c": 0}[key]
                spectra[key, cycle, r] = np.roll(base, move) + draw.normal(0, 0.1, 80)
                if (key, cycle, r) != ("c", 4, 1):
                    rows.append((key, cycle, r, spectra[key, cycle, r].tolist()))
    df = spark.createDataFrame(rows, "k string, c int, r int, s array<double>")
    got = searches.dual_motion(df, "k", "c", "r", "s", 15_000.0, lag=2).collect()
    assert len(got) == 7 + 7 + 5
    for x in got:
        for r in (0, 1):
            lag, corr = displacement(spectra[x.key, x.previous, r], spectra[x.key, x.cycle, r], 20)
            assert x[f"shift_{r}"] == lag * 15_000 and x[f"correlation_{r}"] == pytest.approx(corr)
        assert x.promoted == (x.key == "a")
    reasons = {x.key: set(x.reasons) for x in got}
    assert reasons == {"a": set(), "b": {"disagreement"}, "c": {"shift"}}


def test_windows_of_a_long_capture_are_found_from_the_row(spark):
    """Every row held the starts of all windows of its capture, so work grew with their product."""
    times = [0.3 * i + (0.05 if i % 7 == 0 else 0.0) for i in range(400)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)] + [(2, i, float(i)) for i in range(5)], "k long, row long, t double")
    got = searches.windowed(df, ["k"], 8.0, 2.5, 2)
    a, b = times[0], times[-1]
    starts, i = {b - 8.0}, 0
    while a + i * 2.5 < b - 8.0 + 2.5 and i < int(np.ceil((b - 8.0 + 2.5 - a) / 2.5)):
        starts.add(a + i * 2.5)
        i += 1
    want = sorted((1, s, j) for s in starts for j, t in enumerate(times) if s <= t <= s + 8.0) + [(2, 0.0, j) for j in range(5)]
    assert sorted((r.k, r.start, r.row) for r in got.collect()) == want
    assert "__s" not in got._jdf.queryExecution().analyzed().toString()


def test_rows_of_events_are_not_sent_through_the_driver(spark):
    from orrery.operators import events, spectra

    levels = np.random.default_rng(2).random((12, 32))
    df = spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(levels)], "c long, r long, v array<double>")
    path = events.segmented(df, "c", "r", "v", 0.05)[1]
    pixels = spark.createDataFrame([(1, i, j, float(levels[i, j])) for i in range(12) for j in range(32) if levels[i, j] > 0.7], "c long, r long, bin long, residual double")
    for found in (path, spectra.pixel_events(pixels, "c", "r", 4096)):
        assert "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()
