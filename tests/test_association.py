"""The association search against numpy, with planted satellites and shifts."""

from __future__ import annotations

import numpy as np
import pytest

from orrery.operators import association


def curve(number, t):
    return 30_000 * np.tanh((np.asarray(t) - 60 - 3 * number) / (15 + number)) * -1


def brute(points, number, step, common, reach=2.0, fine=0.05, coarse=0.5, share=0.6, most=200.0):
    """Every shift in turn, with least squares."""
    p = np.array(points, float)
    receivers = sorted(set(p[:, 0]))
    train = np.zeros(len(p), bool)
    for r in receivers:
        t = p[p[:, 0] == r, 1]
        train |= (p[:, 0] == r) & (p[:, 1] <= t.min() + share * (t.max() - t.min()))
    x, w = p[:, 1] - p[train, 1].mean(), 1 / p[:, 3] ** 2
    grid = np.arange(-10, 200) * step

    def judge(shift):
        y = p[:, 2] - np.interp(p[:, 1] + shift, grid, curve(number, grid))
        own = [(p[:, 0] == r) & train for r in receivers]
        centred = lambda z, m: z[m] - np.average(z[m], weights=w[m])
        top = [np.sum(w[m] * centred(x, m) * centred(y, m)) for m in own]
        low = [np.sum(w[m] * centred(x, m) ** 2) for m in own]
        drift = [np.clip(sum(top) / sum(low) if common else a / b, -most, most) for a, b in zip(top, low, strict=True)]
        e = np.zeros(len(p))
        for r, m, d in zip(receivers, own, drift, strict=True):
            mine = p[:, 0] == r
            e[mine] = y[mine] - d * x[mine] - np.average(y[m] - d * x[m], weights=w[m])
        return float(np.sqrt(np.mean(e[train] ** 2))), float(np.sqrt(np.mean(e[~train] ** 2))), shift

    best = min((judge(s) for s in association.shifts_round(-reach, reach, coarse)), key=lambda z: z[:2])
    near = association.shifts_round(max(-reach, best[2] - coarse), min(reach, best[2] + coarse), fine)
    return min([best, *(judge(s) for s in near)], key=lambda z: z[:2])


@pytest.mark.parametrize("common", [False, True])
def test_planted_satellites_rank_first(spark, common):
    rng = np.random.default_rng(11)
    rows, planted = [], {}
    for track in range(6):
        number, shift = int(rng.integers(0, 5)), float(np.round(rng.uniform(-1.6, 1.6) * 20) / 20)
        planted[track] = (number, shift)
        for r in range(2):
            t = np.sort(rng.uniform(30, 110, 25))
            for x, e in zip(t, rng.normal(size=25) * 5, strict=True):
                rows.append((track, r, float(x), float(np.interp(x + shift, np.arange(-10, 200), curve(number, np.arange(-10, 200))) + 4000 * r - 7000 + 3 * x + e), float(5 + r)))
    rows += [(7, 0, float(i), 1.0, 5.0) for i in range(5)] + [(8, 0, float(i), 1.0, 5.0) for i in range(9)] + [(8, 1, 3.0, 1.0, 5.0), (9, 0, None, 1.0, 5.0)]
    points = spark.createDataFrame(rows, "track long, receiver int, at double, observed double, sigma double").repartition(3)
    pairs = spark.createDataFrame([(t, n) for t in range(10) for n in range(5)] + [(0, 77)], "track long, number long")
    grid = [(n, k, float(curve(n, k)), float(curve(n, k + 1))) for n in range(5) for k in range(-10, 199)]
    curves = spark.createDataFrame(grid, "number long, k long, v double, next double")
    ranked = association.associated(points, pairs, curves, 1.0, common=common)
    got = ranked.collect()
    assert {r.track for r in got} == set(planted) and len(got) == 30
    for r in got:
        mine = [x[1:] for x in rows if x[0] == r.track]
        train, held, shift = brute(mine, r.number, 1.0, common)
        assert (r.train_rms, r.holdout_rms) == pytest.approx((train, held), rel=1e-6, abs=1e-6) and r.shift == pytest.approx(shift, abs=1e-9)
        if r.rank == 1:
            assert (r.number, pytest.approx(r.shift, abs=0.11)) == planted[r.track] and r.margin > 100
    assert {r.refused for r in association.gated(ranked, 50.0, 20.0).collect()} == {None}
    assert {r.refused for r in association.gated(ranked, 1.0, 20.0).collect()} == {"error"}
    assert association.associated(points.limit(0), pairs, curves, 1.0).count() == 0


def test_points_of_one_time_are_split_by_number(spark):
    rows = [(1, 0, 5.0, float(i), 1.0) for i in range(10)] + [(1, 1, float(i), float(i), 1.0) for i in range(11)]
    df = spark.createDataFrame(rows, "track long, receiver int, at double, observed double, sigma double")
    got = association.split(df, 0.6).groupBy("receiver", "train").count().collect()
    assert {(r.receiver, r.train): r["count"] for r in got} == {(0, True): 6, (0, False): 4, (1, True): 7, (1, False): 4}


def test_curves_are_not_broadcast(spark):
    """A curve's thousands of values come from one small row, so Spark's own estimate would broadcast all curves."""
    from orrery.operators.association import judged

    points = spark.createDataFrame([(1, 0, 1.0, 5.0, 1.0, True, 6, 0.0)], "track long, receiver int, at double, observed double, sigma double, train boolean, n long, x double")
    tried = spark.createDataFrame([(1, 2, 0.0)], "track long, number long, shift double")
    curves = spark.range(3).selectExpr("id AS number", "explode(sequence(0L, 9L)) AS k").selectExpr("number", "k", "1.0D AS v", "1.0D AS next")
    plan = judged(points, tried, curves, 1.0, 200.0, False)._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "SortMergeJoin" in line and "k#" in line]
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "k#" in line]


def test_a_curve_as_a_function_is_the_table_of_its_values_without_its_shuffle(spark):
    from pyspark.sql import functions as F

    value = lambda number, k: 900.0 * F.sin(k / (30.0 + number)) + number
    rng = np.random.default_rng(3)
    rows = [(track, i % 2, float(t), float(900 * np.sin((t + 0.35) / (30 + track)) + track + 40 * (i % 2)), 5.0) for track in range(5) for i, t in enumerate(np.sort(rng.uniform(2, 190, 40)))]
    rows += [(9, i % 2, 180.0 + 4 * i, float(i), 5.0) for i in range(12)]  # past the end of the curves
    points = spark.createDataFrame(rows, "track long, receiver long, at double, observed double, sigma double")
    candidates = points.select("track", F.explode(F.array(*(F.lit(i).cast("long") for i in range(4)))).alias("number")).distinct()
    grid = spark.range(-10, 201).withColumnRenamed("id", "k").crossJoin(spark.range(4).withColumnRenamed("id", "number"))
    table = grid.select("number", "k", value(F.col("number"), F.col("k")).alias("v"), value(F.col("number"), F.col("k") + 1).alias("next"))
    found = association.associated(points, candidates, association.Curve(value, -10, 200), 1.0)
    by_table = association.associated(points, candidates, table, 1.0)
    close = lambda df: {(r.track, r.number): (r["rank"], round(r.shift, 6), round(r.train_rms, 6), round(r.holdout_rms, 6)) for r in df.collect()}
    assert close(found) == close(by_table) and len(close(found)) == 20
    plan = association.judged(points.withColumns({"x": F.col("at"), "train": F.col("at") < 100, "n": F.lit(40)}), spark.createDataFrame([(0, 0, 0.5)], "track long, number long, shift double"), association.Curve(value, -10, 200), 1.0, 200.0, False)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and "Broadcast" not in text  # points and shifts
