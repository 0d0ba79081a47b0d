"""Greedy selections against the sequential ones."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from orrery.operators import selection


def greedy(rows, near, strict=False):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[0])):
        if None in r[3:] or not any(k[1] == r[1] and all((abs(a - b) < reach) if strict else (abs(a - b) <= reach) for a, b, reach in zip(k[3:], r[3:], near, strict=True)) for k in kept if None not in k[3:]):
            kept.append(r)
    return sorted(r[0] for r in kept)


def test_a_suppressed_row_suppresses_none(spark):
    # a > b > c, where b is near both and c is not near a: c stays.
    rows = [(1, 7, 3.0, 0.0), (2, 7, 2.0, 5.0), (3, 7, 1.0, 10.0), (4, 8, 0.5, 5.0), (5, 7, 9.0, None)]
    df = spark.createDataFrame(rows, "id int, g int, v double, x double")
    assert sorted(r.id for r in selection.suppressed(df, "id", ["g"], [("x", 6)], [-F.col("v")]).collect()) == [1, 3, 4, 5]
    assert selection.suppressed(df.limit(0), "id", ["g"], [("x", 6)], [-F.col("v")]).count() == 0


def test_suppression_against_the_sequential_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), float(rng.randint(0, 40)), float(rng.randint(-60, 60)), rng.random() * 20) for i in range(500)]
    rows += [(1000 + i, 4, float(i), float(i), 0.0) for i in range(12)]  # a chain
    df = spark.createDataFrame(rows, "id int, g int, v double, x double, y double")
    for strict in (False, True):
        got = selection.suppressed(df, "id", ["g"], [("x", 4), ("y", 3.5)], [-F.col("v")], strict)
        assert sorted(r.id for r in got.collect()) == greedy(rows, (4, 3.5), strict) and got.columns == df.columns


def test_matching_against_the_sequential_order(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60), float(rng.randint(0, 12))) for _ in range(400)]
    pairs += [(100, 200, 9.0), (100, 201, 8.0), (101, 200, 7.0), (101, 201, 1.0)]  # crossing: the last one comes in round two
    want, ls, rs = [], set(), set()
    for left, right, s in sorted({(a, b, max(z for x, y, z in pairs if (x, y) == (a, b))) for a, b, _ in pairs}, key=lambda p: (-p[2], p[0], p[1])):
        if left not in ls and right not in rs:
            want.append((left, right, s))
            ls.add(left)
            rs.add(right)
    df = spark.createDataFrame([*pairs, (None, 1, 5.0), (1, None, 5.0)], "l int, r int, s double")
    got = selection.matched(df, "l", "r", "s")
    assert sorted(map(tuple, got.collect())) == sorted(want) and (101, 201, 1.0) in want
    assert selection.matched(df.limit(0), "l", "r", "s").count() == 0


def test_rounds_do_not_go_through_the_driver(spark, monkeypatch):
    from orrery.operators import graph

    plans = []
    for module in (selection, graph):
        kept = module.written
        monkeypatch.setattr(module, "written", lambda df, kind, kept=kept: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, kind))
    df = spark.createDataFrame([(i, 1, float(i % 7), float(i % 50), float(i % 11)) for i in range(200)], "id int, g int, v double, x double, y double")
    found = selection.joined(df, "id", ["g"], [("x", 4), ("y", 3.5)], [-F.col("v")])
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    graph.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"), "a", "b")
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)
