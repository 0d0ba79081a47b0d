"""Operators on small fixtures: planted truth, brute force and properties."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from orrery.operators import currency, estimators, graph, joins, ordered, spectra, stats


def test_running_total_equals_a_single_scan(spark):
    rows = [(i * 7 % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, id long").withColumn("v", F.col("id") % 5)
    got = {r.id: r.total for r in ordered.running_total(df, ["k", "id"], "v", "total", 8).collect()}
    total, want = 0, {}
    for k, i in sorted(rows):
        total += i % 5
        want[i] = total
    assert got == want
    assert ordered.running_total(df.limit(0), ["k", "id"], "v", "total").count() == 0


def test_merge_intervals_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("a", x := rng.randint(0, 400), x + rng.randint(0, 20), rng.choice("pq")) for _ in range(60)]
    got = sorted((r.s, r.e, r.parts) for r in ordered.merge_intervals(spark.createDataFrame(rows, "k string, s long, e long, why string"), ["k"], "s", "e", 2, "why").collect())
    want: list[list[int]] = []
    for _, s, e, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if want and s <= want[-1][1] + 2:
            want[-1][1], want[-1][2] = max(want[-1][1], e), want[-1][2] + 1
        else:
            want.append([s, e, 1])
    assert got == sorted(map(tuple, want))


def test_range_interval_and_as_of_joins(spark):
    rng = random.Random(4)
    left = [(i, rng.choice("ab"), rng.randint(0, 200)) for i in range(80)]
    right = [(i, rng.choice("ab"), x := rng.randint(0, 200), x + rng.randint(0, 70)) for i in range(60)]
    l, r = spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame(right, "j long, k string, a long, b long")
    near = {(x.i, x.j) for x in joins.within(l, r, ["k"], "t", "a", 9).collect()}
    assert near == {(i, j) for i, k, t in left for j, m, a, _ in right if k == m and abs(t - a) <= 9}
    held = sorted((x.i, x.j) for x in joins.contained(l, r, ["k"], "t", "a", "b", 16).collect())
    assert held == sorted((i, j) for i, k, t in left for j, m, a, b in right if k == m and a <= t <= b)
    l2 = l.withColumn("e", F.col("t") + 12)
    met = sorted((x.i, x.j) for x in joins.overlapping(l2, r, ["k"], ("t", "e"), ("a", "b"), 16).collect())
    assert met == sorted((i, j) for i, k, t in left for j, m, a, b in right if k == m and a <= t + 12 and t <= b)
    one = r.groupBy("k", "a").agg(F.max("j").alias("j"))
    got = {x.i: x.a for x in joins.as_of(l, one, ["k"], "t", "a", ["j"]).collect()}
    assert got == {i: max((a for _, m, a, _ in right if m == k and a <= t), default=None) for i, k, t in left}
    got = {x.i: x.a for x in joins.nearest(l, one, ["k"], "t", "a", ["j"]).collect()}
    assert got == {i: min((a for _, m, a, _ in right if m == k), key=lambda a: (abs(a - t), a), default=None) for i, k, t in left}


def test_no_nested_loops(spark):
    l, r = spark.range(100).withColumn("t", F.col("id") * 3), spark.range(100).withColumn("u", F.col("id") * 5)
    plan = joins.within(l, r.drop("id"), [], "t", "u", 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_planted_occupancy_comes_back(spark):
    f, da, db, p = 0.3, 0.8, 0.6, 0.05
    rates = [(f * da + (1 - f) * p, f * db + (1 - f) * p, f * da * db + (1 - f) * p * p), (0.4, 0.4, 0.01), (0.04, 0.3, 0.01)]
    df = spark.createDataFrame(rates, "a double, b double, ab double")
    m = estimators.coincidence(F.col("a"), F.col("b"), F.col("ab"), p)
    got = df.select(*(v.alias(k) for k, v in m.items())).collect()
    assert abs(got[0].f - f) < 1e-9 and abs(got[0].d_a - da) < 1e-9 and abs(got[0].d_b - db) < 1e-9
    assert (got[1].f, got[1].reason) == (None, "anticoincident") and got[2].reason == "no excess"


def test_robust_fit_ignores_outliers(spark):
    rows = [(1, x / 10, 2 + 3 * x / 10 - 0.5 * x * x / 100 + (40 if x in (7, 23) else 0)) for x in range(40)]
    r = estimators.robust_quadratic(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y", 0.1, 12).first()
    assert abs(r.c0 - 2) < 0.1 and abs(r.c1 - 3) < 0.1 and abs(r.c2 + 0.5) < 0.05


def test_bootstrap_weights_are_poisson_and_repeat(spark):
    w = spark.range(20_000).select(estimators.poisson_weight(1, "id").alias("w"))
    r = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(r[0] - 1) < 0.03 and abs(r[1] - 1) < 0.05
    assert w.agg(F.sum("w")).first() == w.agg(F.sum("w")).first()


def test_components_and_families(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 240)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_pixel_events_join_diagonals(spark):
    pixels = [(1, 0, 5, 1.0), (1, 1, 6, 1.0), (1, 2, 6, 2.0), (1, 9, 9, 1.0), (2, 0, 5, 1.0)]
    df = spark.createDataFrame(pixels, "c int, r long, bin long, residual double")
    got = sorted((x.c, x.pixels, x.rows, x.width) for x in spectra.pixel_events(df, "c", "r", 64).collect())
    assert got == [(1, 1, 1, 1), (1, 3, 3, 2), (2, 1, 1, 1)]


def test_threshold_support_and_unknown_rates(spark):
    nulls = spark.createDataFrame([("m", float(i)) for i in range(100)], "k string, s double")
    t = stats.null_threshold(nulls, ["k"], "s", 0.05).first()
    assert t.threshold == 94.0 and t.n == 100 and t.supported
    scores = spark.createDataFrame([("m", 95.0), ("m", 1.0), ("x", 3.0)], "k string, s double")
    got = {r.k: (r.scored, r.rate) for r in stats.firing(scores, stats.null_threshold(nulls, ["k"], "s", 0.05), ["k"], "s").collect()}
    assert got == {"m": (2, 0.5), "x": (1, None)}


def test_drift_states(spark):
    now = spark.createDataFrame([(1, 10, "a"), (2, 10, "b"), (3, 11, "c"), (5, 1, "e")], "i int, m int, d string")
    old = spark.createDataFrame([(1, 10, "a"), (2, 9, "b"), (3, 10, "x"), (4, 1, "d")], "i int, m int, d string")
    got = {r.i: r.state for r in currency.drift(now, old, ["i"], ["m"], "d").collect()}
    assert got == {1: "current", 2: "touched", 3: "changed", 4: "gone", 5: "added"}


def test_order_statistics_of_odd_groups(spark):
    import math

    from orrery.operators import stats

    rng = np.random.default_rng(4)
    groups = {"a": [1.0], "b": [2.0] * 50, "c": rng.normal(size=999).tolist(), "d": [*rng.normal(size=40).tolist(), math.nan, math.inf, -math.inf], None: [5.0, 1e300, -1e300, 0.0], "e": (1e9 + rng.random(300) * 1e-3).tolist(), "f": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("f", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in stats.describe(df, ["g"], "v").collect()}
    assert set(got) == set(groups) - {"f"}
    for g, vs in groups.items():
        order = sorted(vs, key=lambda v: (math.isnan(v), v))
        for name, f in (("minimum", 0), ("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("maximum", 1)):
            if vs:
                want, have = order[round(f * (len(vs) - 1))], got[g][name]
                assert have == want or math.isnan(have) and math.isnan(want)
    whole = stats.order_statistics(df.where("g in ('c', 'e')"), [], "v", {"m": stats.at_fraction(0.5)}).first()
    assert whole.m == sorted(groups["c"] + groups["e"])[round(0.5 * 1298)] and whole.n == 1299
    assert stats.order_statistics(df.limit(0), ["g"], "v", {"m": stats.at_fraction(0.5)}).count() == 0


def test_no_single_task_over_values(spark):
    from orrery.operators import stats

    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    for keys in ([], ["g"]):
        plan = stats.order_statistics(df, keys, "v", {"m": stats.at_fraction(0.5)})._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(v" not in plan and ("windowspecdefinition(g#" not in plan or "__pick" in plan)


def test_an_outlier_leaves_no_bracket_with_most_values(spark):
    from orrery.operators import stats

    rng = np.random.default_rng(6)
    values = [*rng.lognormal(size=60_000).tolist(), 1e9]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
    picks = {"p50": stats.at_fraction(0.5), "p90": stats.at_fraction(0.9), "top": stats.at_fraction(1)}
    r = stats.order_statistics(df, [], "v", picks).first()
    order = sorted(values)
    assert (r.p50, r.p90, r.top, r.n) == (order[30_000], order[54_000], 1e9, 60_001)
    cuts = df.select(F.percentile_approx("v", [i / stats.CUTS for i in range(stats.CUTS + 1)], stats.ACCURACY).alias("c")).first().c
    held = np.histogram(values, bins=np.unique(cuts))[0]
    assert held.max() < 0.01 * len(values)


def test_best_lag_of_a_constant_spectrum(spark):
    from orrery.operators import spectra

    rows = [("a", b, 1.0) for b in range(8)] + [("b", b, float(b * b % 7)) for b in range(8)]
    df = spark.createDataFrame(rows, "k string, bin long, level double")
    got = {r.k: r for r in spectra.best_lag(df, df, ["k"], 1).collect()}
    assert got["a"].r is None and (got["b"].lag, got["b"].r) == (0, 1.0)


def test_medians_in_cells_equal_sorting(spark):
    """Skewed, crowded, constant, infinite and null values, with a null key; no plan gathers a group in one buffer."""
    import numpy as np

    from orrery.operators import stats

    rng = np.random.default_rng(4)
    inf = float("inf")
    groups = {"skew": [*np.exp(rng.normal(0, 9, 401))], "crowd": [*(1e6 + rng.random(300) * 1e-6), -1e12, 1e15], "one": [2.5] * 7, "two": [1.0, 4.0], "inf": [-inf, -inf, 3.0, inf, inf, inf], None: [*rng.integers(0, 5, 50).astype(float)], "nan": [1.0, 2.0, float("nan")]}
    rows = [(k, i % 2, float(x)) for k, xs in groups.items() for i, x in enumerate(xs)] + [("none", 0, None), ("one", 1, None)]
    df = spark.createDataFrame(rows, "k string, side int, x double").repartition(3)
    got = stats.medians_of_sets(df, ["k"], [["k"], []], lambda g: g.agg(F.count("*").alias("n")), {"m": F.col("x"), "odd": F.when(F.col("side") == 1, F.col("x"))})
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString()
    found = sorted(((r.k or "", r.n), (r.m, r.odd)) for r in got.where("n < 500").collect() if r.k != "none")
    want = sorted(((k or "", len(xs) + (k == "one")), (float(np.median(np.array(xs))) if k != "nan" else 2.0, float(np.median(xs[1::2])))) for k, xs in groups.items())
    assert [k for k, _ in found] == [k for k, _ in want]
    assert np.allclose([v for _, v in found], [v for _, v in want], rtol=1e-12, equal_nan=True)
    every = [x for xs in groups.values() for x in xs]
    whole = got.where(f"n = {len(rows)}").first()
    assert whole.k is None and whole.m == pytest.approx(sorted(every, key=lambda x: (x != x, x))[len(every) // 2] if len(every) % 2 else np.mean(sorted(every, key=lambda x: (x != x, x))[len(every) // 2 - 1 : len(every) // 2 + 1]))


def test_band_join_counts_equal_prices_once(spark):
    from types import SimpleNamespace

    from orrery.plans import join_queries

    events = spark.createDataFrame([(1, 10.0), (2, 10.08), (3, 50.0)], "event_id long, value double")
    part = spark.createDataFrame([(9, 50.0), (3, 50.0), (4, 50.5), (5, 49.5), (6, 50.75)], "p_partkey long, p_retailprice double")
    got = join_queries.j21(SimpleNamespace(events=events, part=part))
    assert sorted(map(tuple, got.collect())) == [(1, 4, 3), (2, 4, 4)]
    assert "Aggregate [p_retailprice" in got._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_and_exceedances_are_no_groups_task(spark):
    """Ranks come from ranges of counted values; ties, nulls, NaN and copies count as in one sort."""
    from orrery.operators import stats

    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *map(float, range(6))]), rng.choice([None, rng.random(), float(rng.randint(0, 3))])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    high = lambda v: (v is None, 0.0 if v is None else math.inf if v != v else v)

    def rank(values):
        s = sorted(map(high, values))
        return [s.index(high(v)) + (s.count(high(v)) + 1) / 2 for v in values]

    want = {}
    for k in ("a", "b", None):
        mine = [r for r in rows if r[0] == k]
        a, b = rank([r[1] for r in mine]), rank([r[2] for r in mine])
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        want[k] = sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / math.sqrt(sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b))
    got = stats.spearman(df, ["k"], "x", "y")
    assert {r.k: r.rho for r in got.collect()} == pytest.approx(want)

    seen, nulls = df.where("y < 2"), df.where("x < 4")
    found = stats.smoothed_exceedance(seen, nulls, ["k"], "y")
    below = [(k, y) for k, x, y in rows if x is not None and x < 4 and y is not None]
    exact = sorted((str(k), y, (1 + sum(q == k and v >= y for q, v in below)) / (1 + sum(q == k for q, _ in below))) for k, _, y in rows if y is not None and y < 2)
    assert sorted((str(r.k), r.y, r.p) for r in found.collect()) == exact
    for plan in (got, found):
        assert not re.search(r"windowspecdefinition\(k#\d+, [xys]#", plan._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("values", ["spread", "tied", "null"])
def test_bootstrap_medians_equal_a_sort_of_each_draw(spark, values):
    """The medians are those of all drawn rows, also where the first bracket misses them."""
    make = {"spread": lambda i: i * 37 % 1009 / 7, "tied": lambda i: float(i % 3), "null": lambda i: None if i % 5 < 3 else float(i)}[values]
    rows = spark.createDataFrame([(i, make(i)) for i in range(700)], "id long, v double")
    drawn = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(12)))).withColumn("w", estimators.poisson_weight(3, "draw", "id")).where("w > 0")
    want = {r.draw: r.v for r in estimators.weighted_median(drawn, ["draw"], "v", "w").collect()}
    assert {r.draw: r.v for r in estimators.bootstrap_medians(rows, "id", "v", 12, 3).collect()} == want
    assert {r.draw: r.v for r in estimators.bootstrap_medians(rows, "id", "v", 12, 3, 0.001).collect()} == want
