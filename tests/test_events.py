"""Events of waterfalls against numpy: convolution, closing and flood fill written out."""

from __future__ import annotations

import numpy as np
import pytest

from orrery.operators import events


def brute(psd, threshold, least=(3, 3, 12)):
    flat = psd - np.median(psd, axis=0, keepdims=True)
    w = np.array(events.kernel(1.0))
    rows, bins = flat.shape
    pick = lambda i, n: np.clip(np.arange(i - 4, i + 5), 0, n - 1)
    half = np.stack([(flat[:, pick(b, bins)] * w).sum(axis=1) for b in range(bins)], axis=1)
    smooth = np.stack([(half[pick(r, rows)] * w[:, None]).sum(axis=0) for r in range(rows)])
    out = []
    for sign in (1, -1):
        m = np.pad(sign * smooth >= threshold, 1)
        d = m[1:, 1:] | m[:-1, 1:] | m[1:, :-1] | m[:-1, :-1]
        mask = (d[:-1, :-1] & d[1:, :-1] & d[:-1, 1:] & d[1:, 1:])[: rows, : bins]
        left = {tuple(x) for x in np.argwhere(mask)}
        while left:
            todo, seen = [left.pop()], []
            while todo:
                r, b = todo.pop()
                seen.append((r, b))
                near = {(r + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            r, b = np.array(seen).T
            if np.ptp(r) + 1 < least[0] or np.ptp(b) + 1 < least[1] or len(r) < least[2]:
                continue
            path = []
            for x in range(r.min(), r.max() + 1):
                own = np.sort(b[r == x])
                weight = np.maximum(sign * flat[x, own], np.finfo(float).eps)
                path.append((float(np.average(own, weights=weight)), int(own[0]), int(own[-1]), len(own)))
            c = np.array(path)
            slope = np.polyfit(np.arange(len(c)), c[:, 0], 1)[0] if len(c) > 1 else np.nan
            out.append((sign, int(r.min()), int(r.max()), int(b.min()), int(b.max()), len(r), float(np.median(c[:, 2] - c[:, 1] + 1)), float((sign * flat)[r, b].max()), float(np.median(c[:, 3]) / bins), float(slope)))
    return sorted(out)


def waterfalls():
    rng = np.random.default_rng(12)
    out = {}
    for capture in range(3):
        psd = rng.normal(0, 0.15, (40, 60))
        for r in range(8, 30):
            at = 10 + r + 3 * capture
            psd[r, at : at + 4] += 2.0
            psd[r, 55 - r : 58 - r] -= 2.0
        psd[36:40, 2:58] += 3.0  # broadband
        psd[2, 20:30] += 5.0  # one row only
        out[capture] = psd
    return out


def test_events_against_numpy(spark):
    planted = waterfalls()
    df = spark.createDataFrame([(c, r, x.tolist(), "x") for c, psd in planted.items() for r, x in enumerate(psd)], "label int, rw long, embedding array<double>, event string").repartition(4)
    found, path = events.segmented(df, "label", "rw", "embedding", 0.35)
    tracks = {r.event: r for r in events.candidates(found, path, 0.1, 200.0).collect()}
    got = {}
    for r in found.collect():
        got.setdefault(r.capture, []).append((r.polarity, r.start, r.stop, r.low, r.high, r.pixels, r.bandwidth, r.peak, r.occupancy, tracks[r.event].drift_hz_s * 0.1 / 200.0))
    for c, psd in planted.items():
        want = brute(psd, 0.35)
        mine = sorted(got[c])
        assert len(mine) == len(want) >= 3
        for a, b in zip(mine, want, strict=True):
            assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:], rel=1e-6)
    reasons = {tuple(r.reasons) for r in tracks.values()}
    assert () in reasons and any("broadband" in x for x in reasons)
    best = [r for r in tracks.values() if r.place == 1]
    assert len(best) == 3 and all(r.qualified and abs(abs(r.drift_hz_s) - 2000) < 300 for r in best)
    none, _ = events.segmented(df.limit(0), "label", "rw", "embedding", 0.35)
    assert none.count() == 0
