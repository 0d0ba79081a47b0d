"""Pass hypotheses against numpy, and their edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from orrery.operators.hypotheses import pass_hypotheses, rate_matches

POINTS = "radio long, event long, t double, y double"
PASSES = "radio long, pass string, t0 double, y0 double, t1 double, y1 double, t2 double, y2 double, elevation double"


def brute(points, passes, residual_scale, drift_scale):
    found = []
    t, y = np.array(points).T
    for name, t0, y0, t1, y1, t2, y2, elevation in passes:
        inside = (t >= t0) & (t <= t2)
        if inside.sum() < 3 or inside.mean() < 0.25:
            continue
        line = np.interp(t[inside], [t0, t1, t2], [y0, y1, y2])
        rest = y[inside] - line
        bias = float(np.median(rest))
        rms = float(np.sqrt(np.mean((rest - bias) ** 2)))
        drift = abs(np.polyfit(t[inside], y[inside], 1)[0] - np.polyfit(t[inside], line, 1)[0])
        score = inside.mean() * (0.5 + 0.5 * min(1, elevation / 45)) * math.exp(-rms / residual_scale) * math.exp(-drift / drift_scale)
        found.append((name, bias, rms, drift, score))
    return sorted(found, key=lambda f: -f[4])


def test_planted_pass_ranks_first(spark):
    rng = np.random.default_rng(4)
    nodes = [(f"p{i}", a, 40.0 - i, a + 5, 10.0 * i, a + 11, -40.0, 15.0 + 10 * i) for i, a in enumerate((0.0, 2.0, 4.0, 30.0))]
    t = np.sort(rng.uniform(0, 11, 24))
    y = np.interp(t, [2.0, 7.0, 13.0], [39.0, 10.0, -40.0]) + 6 + rng.normal(0, 0.5, 24)
    points = list(zip(t.tolist(), y.tolist(), strict=True))
    df = spark.createDataFrame([(1, 9, *p) for p in points] + [(1, 9, None, 1.0), (1, 9, 3.0, None)], POINTS)
    got = pass_hypotheses(df, spark.createDataFrame([(1, *n) for n in nodes], PASSES), ["radio"], "event", 4.0, 20.0, 5.0).orderBy("rank").collect()
    want = brute(points, nodes, 20.0, 5.0)
    assert [r["pass"] for r in got] == [w[0] for w in want] and got[0]["pass"] == "p1"
    for r, w in zip(got, want, strict=True):
        assert (r.bias, r.rms, r.drift_difference, r.score) == pytest.approx(w[1:], abs=1e-9)
    assert {r.kind for r in got} == {"ambiguous" if want[0][4] / want[1][4] < 1.5 else "ranked"}
    assert got[0].bias == pytest.approx(6, abs=0.5)


def test_events_without_hypotheses_and_ties(spark):
    flat = lambda name, radio: (radio, name, 0.0, 1.0, 5.0, 1.0, 10.0, 1.0, 45.0)
    rows = [(1, 1, float(i), 1.0) for i in range(4)] + [(2, 2, 50.0 + i, 1.0) for i in range(4)] + [(1, 3, 1.0, 1.0), (1, 3, 2.0, 1.0)] + [(3, 4, 2.0, 1.0)] * 3
    df = spark.createDataFrame(rows, POINTS)
    passes = spark.createDataFrame([flat("b", 1), flat("a", 1), flat("a", 2), flat("c", 3), (3, "point", 2.0, 1.0, 2.0, 1.0, 2.0, 1.0, 45.0)], PASSES)
    got = pass_hypotheses(df, passes, ["radio"], "event", 4.0, 20.0, 5.0)
    assert sorted((r.event, r["pass"], r["rank"], r.kind) for r in got.where("event = 1").collect()) == [(1, "a", 1, "ambiguous"), (1, "b", 2, "ambiguous")]
    assert [(r["pass"], r.kind) for r in got.where("event = 2").collect()] == [(None, "unmatched")]
    assert got.where("event = 3").count() == 0  # two points
    assert [r["pass"] for r in got.where("event = 4").orderBy("rank").collect()] == ["c", "point"]  # one time thrice
    assert pass_hypotheses(df.limit(0), passes, ["radio"], "event", 4.0, 20.0, 5.0).count() == 0
    assert {r.kind for r in pass_hypotheses(df, passes.limit(0), ["radio"], "event", 4.0, 20.0, 5.0).collect()} == {"unmatched"}


def test_rates_against_numpy(spark):
    rng = np.random.default_rng(6)
    nodes = [(f"p{i}", a, *rng.uniform(-50, 50, 1).tolist(), a + 3, 20.0, a + 8, -30.0 + 9 * i, 45.0) for i, a in enumerate((0.0, 1.5, 3.0, 25.0))]
    spans = [(1, 1.0, 6.0, -9.0), (2, 4.0, 40.0, 2.0), (3, 50.0, 60.0, 1.0), (4, 5.0, 5.0, 1.0), (5, 2.0, 3.0, None)]
    tracks = spark.createDataFrame([(1, *s) for s in spans], "radio long, event long, a double, b double, drift double")
    got = rate_matches(tracks, spark.createDataFrame([(1, *n) for n in nodes], PASSES), ["radio"], "event", 4.0, 10.0).collect()
    for event, a, b, drift in spans[:2]:
        want = []
        for name, t0, y0, t1, y1, t2, y2, _ in nodes:
            start, stop = max(a, t0), min(b, t2)
            if stop > start:
                ends = np.interp([start, stop], [t0, t1, t2], [y0, y1, y2])
                off = abs(drift - (ends[1] - ends[0]) / (stop - start))
                want.append(((stop - start) / (b - a) * math.exp(-off / 10), name, off <= 10))
        want.sort(key=lambda w: (-w[0], w[1]))
        rows = sorted((r for r in got if r.event == event), key=lambda r: r["rank"])
        assert [r["pass"] for r in rows] == [w[1] for w in want]
        assert [r.confidence for r in rows] == pytest.approx([w[0] for w in want])
        assert [r.compatible for r in rows] == [w[2] for w in want]
        assert {r.compatible_passes for r in rows} == {sum(w[2] for w in want)}
        assert rows[0].margin == pytest.approx(want[0][0] - want[1][0]) and rows[1].margin is None
        assert [r.qualified for r in rows] == [bool(want[0][2] and want[0][0] - want[1][0] >= 0.15)] + [False] * (len(want) - 1)
    assert {r.event for r in got} == {1, 2}


def test_a_lone_match_leads_by_all_of_it(spark):
    tracks = spark.createDataFrame([(1, 1, 0.0, 4.0, -1.0)], "radio long, event long, a double, b double, drift double")
    passes = spark.createDataFrame([(1, "a", 0.0, 4.0, 2.0, 2.0, 4.0, 0.0, 45.0)], PASSES)
    (row,) = rate_matches(tracks, passes, ["radio"], "event", 4.0, 10.0).collect()
    assert (row.confidence, row.margin, row.qualified) == (1.0, 1.0, True)
    assert rate_matches(tracks.limit(0), passes, ["radio"], "event", 4.0, 10.0).count() == 0
