"""Novelty against a baseline and edges of broad signals, against numpy written out."""

from __future__ import annotations

import numpy as np
import pytest

from orrery.operators import events, profiles

SCHEMA = "capture long, receiver int, row long, t double, level array<double>"


def frame(spark, captures):
    rows = [(c, r, i, float(i), x.tolist()) for c, both in captures.items() for r, psd in enumerate(both) for i, x in enumerate(psd)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def gaussian(x, sigma):
    w = np.array(events.kernel(sigma))
    pad = len(w) // 2
    return np.convolve(np.pad(x, pad, mode="edge"), w[::-1], "valid")


def brute_novelty(psd, base, spread, threshold, trend, reach):
    n = len(base)
    profile = np.median(psd, axis=0)
    profile = profile - np.median(profile)
    tried = []
    for lag in range(-min(reach, n // 4), min(reach, n // 4) + 1):
        a = base[max(0, -lag) : n - max(0, lag)]
        b = profile[max(0, lag) : n - max(0, -lag)]
        tried.append((np.corrcoef(a, b)[0, 1], -lag))
    r, back = max(tried)
    lag, first = -back, max(0, back)
    part = psd - np.median(psd, axis=1, keepdims=True)
    part = part[:, max(0, lag) : n - max(0, -lag)] - base[first : n - max(0, lag)]
    left = np.stack([x - gaussian(x, trend) for x in part])
    limit = np.maximum(threshold, 3 * spread[first : n - max(0, lag)])
    excess = (left - limit).max(axis=0)
    return lag, r, np.median(np.abs(left)), np.percentile(np.abs(left), 99), (left > limit).mean(), (left < -limit).mean(), first + int(excess.argmax())


def test_novelty_against_numpy(spark):
    draw = np.random.default_rng(4)
    shape = draw.normal(0, 1, 140)
    past = {c: np.stack([np.stack([shape[10:130] * (1 + r) + draw.normal(0, 0.1, 120) for _ in range(9)]) for r in (0, 1)]) for c in range(5)}
    base = profiles.baselines(frame(spark, past))
    known = {b.receiver: b for b in base.collect()}
    for r in (0, 1):
        own = np.stack([np.median(past[c][r], axis=0) for c in past])
        own -= np.median(own, axis=1, keepdims=True)
        assert known[r].base == pytest.approx(np.median(own, axis=0)) and known[r].coverage == 5
        assert known[r].spread == pytest.approx(1.4826 * np.median(np.abs(own - np.median(own, axis=0)), axis=0))
    new = {c: np.stack([np.stack([shape[10 - m : 130 - m] * (1 + r) + draw.normal(0, 0.1, 120) for _ in range(8)]) for r in (0, 1)]) for c, m in ((11, 0), (12, 4), (13, -6))}
    new[12][0, 3, 50] += 9.0
    new[13][1, :, 70] -= 9.0
    got = {(x.capture, x.receiver): x for x in profiles.novelty(frame(spark, new), base, threshold=0.5, trend=15.0, reach=20).collect()}
    assert set(got) == {(c, r) for c in new for r in (0, 1)}
    for (c, r), x in got.items():
        want = brute_novelty(new[c][r], np.array(known[r].base), np.array(known[r].spread), 0.5, 15.0, 20)
        assert x.lag == want[0] and (x.registration, x.median_abs, x.p99_abs, x.positive, x.negative) == pytest.approx(want[1:6])
        assert len(x.strongest) <= 20
    assert [got[c, 0].lag for c in (11, 12, 13)] == [0, 4, -6]
    assert got[12, 0].strongest[0] == 46 == brute_novelty(new[12][0], np.array(known[0].base), np.array(known[0].spread), 0.5, 15.0, 20)[6]
    assert got[13, 1].negative > 0.005 and profiles.novelty(frame(spark, new).limit(0), base).count() == 0


def test_strongest_bins_fill_up():
    assert profiles.strongest(np.array([3.0, 1, 2, 0.5, -1]), 0.3, 9) == [2, 0]
    assert profiles.strongest(np.array([-3.0, -1, -2]), 0.3, 9) == [1]
    assert profiles.strongest(np.array([1.0, 1, 1]), 0.3, 9) == [0, 2]


def test_edges_and_their_controls(spark):
    def band(low, high):
        psd = np.random.default_rng(1).normal(0, 0.01, (2, 20, 150))
        for i in range(20):
            psd[:, i, low(i) : high(i)] += 1.0
        return psd

    psd = {
        1: band(lambda i: 20 + 4 * i, lambda i: 32 + 4 * i),  # moves
        2: band(lambda i: 60 - 3 * i, lambda i: 72 + 3 * i),  # grows
        3: band(lambda i: 5 + 25 * (7 * i % 5), lambda i: 20 + 25 * (7 * i % 5)),  # hops
    }
    got = profiles.edges(frame(spark, psd), 10_000.0, 30.0, 10.0, threshold=0.3).collect()
    for x in got:
        flat = psd[x.capture][x.receiver]
        flat = flat - np.median(flat, axis=0)
        rows = []
        for i, v in enumerate(flat):
            w = np.maximum(np.abs(v) - 0.15, 0)
            on = np.flatnonzero(w >= 0.15)
            if on.size >= 2 and on[-1] - on[0] >= 10:
                rows.append((i, on[0], on[-1], (w * np.arange(150)).sum() / w.sum(), np.abs(v[on]).mean()))
        t, low, high, centre, power = np.array(rows, float).T
        fits = [np.polyfit(t, y, 1) for y in (centre, low, high)]
        assert x.rows == len(rows) and (x.centre_drift, x.low_drift, x.high_drift) == pytest.approx([f[0] * 10_000 for f in fits], abs=1e-6) and x.strength == pytest.approx(power.mean())
        off = np.r_[low - np.polyval(fits[1], t), high - np.polyval(fits[2], t)]
        assert x.linearity_bins == pytest.approx(np.sqrt((off**2).mean()), abs=1e-6) and x.motion_bins == min(np.ptp(low), np.ptp(high))
        assert x.width_spread == pytest.approx(1.4826 * np.median(np.abs(high - low - np.median(high - low))) / np.median(high - low))
    reasons = {x.capture: set(x.reasons) for x in got}
    assert reasons[1] == set() and {"edges do not move alike", "width not stable"} & reasons[2] and "motion not linear" in reasons[3]
    assert profiles.edges(frame(spark, psd).limit(0), 10_000.0, 30.0, 10.0).count() == 0
