"""Grouped steps on planted tracks, and exact intervals against published values."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import defaultdict
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from orrery.operators import tracks
from orrery.plans import join_queries, registry, track_queries

START = dt.datetime(2024, 1, 1)


def events_of(spark, rows):
    """(event_id, user_id, second, type, value) as the table of events."""
    stamped = [(i, u, START + dt.timedelta(seconds=s), k, v) for i, u, s, k, v in rows]
    return spark.createDataFrame(stamped, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double")


def test_points_join_the_first_representative(spark):
    rows = [(1, 0, 2.0, 10.0), (1, 1, 99.0, 11.0), (1, 2, 50.0, 10.0), (1, 3, 3.0, 40.0), (2, 4, 0.0, 0.0)]
    got = tracks.clustered(spark.createDataFrame(rows, "k long, i long, p double, v double"), "k", "i", "p", "v", 100, 4, 5).collect()
    assert sorted((r.key, r.cluster, r.points) for r in got) == [(1, 0, 2), (1, 1, 1), (1, 2, 1), (2, 0, 1)]


def test_two_crossing_lines_are_two_tracks(spark):
    rows = [(7, float(t), 100.0 - 2 * t) for t in range(30)] + [(7, t + 0.5, 2.0 * t) for t in range(30)] + [(7, 500.0, 0.0)]
    got = tracks.assembled(spark.createDataFrame(rows, "k long, t double, v double"), "k", "t", "v", 5, 3.0, 0.5).collect()
    assert sorted((r.points, round(r.drift, 3)) for r in got) == [(30, -2.0), (30, 2.0)]


def test_poisson_interval(spark):
    got = spark.createDataFrame([(0,), (1,), (10,), (100,)], "n long").select("n", tracks.poisson_bounds(F.col("n")).alias("b")).collect()
    want = {0: (0.0, 3.6889), 1: (0.0253, 5.5716), 10: (4.7954, 18.3904), 100: (81.3634, 121.6266)}
    for r in got:
        assert (r.b.low, r.b.high) == pytest.approx(want[r.n], abs=2e-3)


def test_whole_matches_take_every_user(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(60), rng.randrange(4 * 86_400), rng.choice(["view", "click", "error"]), rng.random() * 100) for i in range(1500)]
    t = SimpleNamespace(events=events_of(spark, rows))
    days = defaultdict(list)
    for _, u, s, k, v in rows:
        days[u, k, s // 86_400].append((s, v))
    epoch = int((START - dt.datetime(1970, 1, 1)).total_seconds())
    tr = [(u, k, epoch + min(x)[0], epoch + max(x)[0], sum(v for _, v in x) / len(x)) for (u, k, _), x in days.items()]
    rate, hypotheses = {}, {}
    for u, k, a, b, m in tr:
        if k == "view":
            met = sorted((abs(m - cm), c) for c, j, ca, cb, cm in tr if j == "click" and a <= cb and ca <= b and b > a)
            if met:
                rate[u, a] = (met[0][1], len(met) == 1 or met[1][0] - met[0][0] >= 0.15)
            scored = sorted((-math.exp(-abs(m - cm) / 25), c) for c, j, ca, cb, cm in tr if j == "error" and b > a and (min(b, cb) - max(a, ca)) / (b - a) >= 0.25)
            if scored:
                hypotheses[u, a] = scored[0][1]
    assert max(u for u, _ in rate) >= 30 and max(u for u, _ in hypotheses) >= 20
    assert {(r.user_id, r.a): (r.cand, r.decisive) for r in track_queries.j26(t).collect()} == rate
    assert {(r.user_id, r.a): r.cand for r in join_queries.j25(t).collect()} == hypotheses
    highest = defaultdict(float)
    for _, u, _, _, v in rows:
        highest[u] = max(highest[u], v - 60)
    want = sorted(((-h, u) for u, h in highest.items() if h >= -1))[:40]
    assert [(-r.highest, r.user_id) for r in track_queries.o05(t).collect()] == want


def test_whole_pass_samples_take_every_customer(spark):
    orders = spark.createDataFrame([(i, c, START) for i, c in enumerate((1, 199, 200, 5000))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    got = track_queries.o07(SimpleNamespace(orders=orders)).collect()
    day = (START - dt.datetime(1970, 1, 1)).days
    assert sorted((r.o_orderkey, r.samples, r["first"], r["last"]) for r in got) == [(i, 5, day, day + 20) for i in range(4)]


def test_whole_queries_have_no_id_filter():
    for name in ("j25_event_hypotheses", "j26_rate_match", "o05_visibility_screen", "o07_pass_tracks"):
        assert not any(x in registry.ORACLE_SQL[name] for x in ("user_id <", "o_custkey <", "% 3"))


@pytest.mark.parametrize("users", [20, 600])
@pytest.mark.parametrize("planted", [False, True])
def test_cluster_permutation_keeps_each_users_number(spark, users, planted):
    import numpy as np

    rng = np.random.default_rng(users)
    n = users * 25
    user, second, value = rng.integers(0, users, n), rng.integers(0, 60 * 86_400, n), rng.random(n) * 75
    if planted:
        user[:3], second[:3], value[:3] = 1, (5000, 5001, 5002), 70
    hit = np.flatnonzero(value > 60)

    def least(labels, at):
        order = np.lexsort((at, labels))
        u, s = labels[order], at[order]
        return (s[2:] - s[:-2])[u[2:] == u[:-2]].min()

    observed = least(user[hit], second[hit])
    brute = np.mean([least(user[hit], second[rng.permutation(n)[: len(hit)]]) <= observed for _ in range(400)])
    df = events_of(spark, [(i, int(user[i]), int(second[i]), "view", float(value[i])) for i in range(n)])
    got = track_queries.a39p(SimpleNamespace(events=df)).first()
    assert got.draws == track_queries.DRAWS
    assert got.p == pytest.approx(brute, abs=0.12) and (got.p < 0.02 or not planted)


@pytest.mark.parametrize("users, reach, slice_rows, large", [(300, 4_000, 200, 1024), (300, 60_000, 200, 6), (30, 2_000, 5_000, 1024), (900, 600_000, 100, 1024)])
def test_permuted_labels_against_all_of_them(spark, monkeypatch, users, reach, slice_rows, large):
    """The draws with three labels within reach are those of brute force; labels are not shuffled, however many draws there are."""
    import numpy as np

    from orrery.operators import permutation

    monkeypatch.setattr(permutation, "SLICE", slice_rows)
    monkeypatch.setattr(permutation, "LARGE", large)
    rng = np.random.default_rng(users)
    n = 3_000
    at = np.sort(rng.integers(0, 3_000_000, n))
    labels = rng.multinomial(1_000 if users < 900 else 700, np.arange(1, users + 1) / (users * (users + 1) / 2)) if users < 900 else np.r_[[3] * 6, [2] * 300]
    assert sorted(permutation.permuted(np.arange(n), n, 5)) == list(range(n))
    rows = spark.createDataFrame([(int(u), i) for i, u in enumerate(at)] + [(None, n)], "us long, i long")
    owners = spark.createDataFrame([(u, int(c)) for u, c in enumerate(labels)], "user long, labels long")
    spans = {r.start: r.labels for r in permutation.numbered(owners, "user").collect()}
    assert sorted(spans.values()) == sorted(int(c) for c in labels if c >= 3)
    owner = np.repeat(sorted(spans), [spans[s] for s in sorted(spans)])
    want = set()
    for draw in range(1, 31):
        place = permutation.permuted(np.arange(n), n + 1, draw)  # the time that is null has the last number
        on = place < len(owner)
        if permutation.closest(owner[place[on]], at[on]) <= reach:
            want.add(draw)
    assert 0 < len(want) < 30 or users == 30
    assert permutation.as_close(rows, "us", "i", owners, "user", reach, 30) == want


def test_cluster_permutation_without_three_hits(spark):
    df = events_of(spark, [(i, i, i * 100, "view", 70.0) for i in range(5)])
    assert track_queries.a39p(SimpleNamespace(events=df)).first().p is None


def test_clusters_against_the_scan(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2]), i, float(rng.randint(0, 900)), float(rng.randint(0, 60))) for i in range(400)]
    got = tracks.clustered(spark.createDataFrame([*rows, (1, 999, None, 1.0)], "k long, i long, p double, v double").repartition(5), "k", "i", "p", "v", 100, 12, 9).collect()
    want = []
    for key in (1, 2):
        reps, sizes = [], []
        for k, _, p, v in rows:
            if k != key:
                continue
            for j, (rp, rv) in enumerate(reps):
                gap = (p - rp) % 100
                if min(gap, 100 - gap) <= 12 and abs(v - rv) <= 9:
                    sizes[j] += 1
                    break
            else:
                reps.append((p, v))
                sizes.append(1)
        want += [(key, j, n) for j, n in enumerate(sizes)]
    assert sorted((r.key, r.cluster, r.points) for r in got) == want


def test_a_hot_key_is_cut_into_sessions(spark):
    rng = random.Random(5)
    times, t = [], 0.0
    for _ in range(3000):
        t += rng.choice([1.0, 2.0, 3.0, 5.0, 5.5, 400.0 if rng.random() < 0.02 else 1.0])
        times.append(t)
    df = spark.createDataFrame([(7, t, float(i % 5)) for i, t in enumerate(times)] + [(8, 3.0, 1.0)], "k long, t double, v double").repartition(4)
    got = {r.t: r.session for r in tracks.sessions(df, "k", "t", 5.0, width=40.0).where("k = 7").collect()}
    want, n = {}, 0
    for a, b in zip([None, *times], times, strict=False):
        n += a is None or b - a > 5.0
        want[b] = n
    assert len(set(want.values())) > 20 and [got[t] for t in times] == [want[t] for t in times]
    one = tracks.assembled(df, "k", "t", "v", 5.0, 0.4, 0.0)
    assert max(r["count"] for r in tracks.sessions(df, "k", "t", 5.0).groupBy("k", "session").count().collect()) < 1500
    tr = [r.track for r in one.where("key = 7").collect()]
    assert sorted(tr) == list(range(len(tr)))


def test_tracks_are_followed_as_point_by_point():
    import numpy as np

    rng = np.random.default_rng(11)
    t = np.sort(np.concatenate([rng.integers(0, 900, 600) / 2.0, rng.integers(4000, 4040, 300) / 4.0]))
    v = rng.random(len(t)) * 120
    v[7] = np.nan
    gap, base, slope = 6.0, 2.0, 0.25
    groups = []
    for i in range(len(t)):
        best, miss = None, np.inf
        for g in groups:
            dt = t[i] - t[g[-1]]
            if not 0 < dt <= gap:
                continue
            x, y = t[g[-6:]], v[g[-6:]]
            rate = ((x - x.mean()) * (y - y.mean())).sum() / max(((x - x.mean()) ** 2).sum(), 1e-12) if len(x) > 1 else 0.0
            off = abs(y.mean() + rate * (t[i] - x.mean()) - v[i])
            if off <= base + slope * dt and off < miss:
                best, miss = g, off
        (best if best is not None else groups.append([]) or groups[-1]).append(i)
    assert tracks.followed(t, v, gap, base, slope) == groups
    assert max(map(len, groups)) > 6 and len(groups) > 64


def test_sessions_are_assembled_by_more_than_one_task(spark):
    """Few bytes, much work: all of them in one small partition took one core."""
    rows = [(k, float(t), float(k)) for k in range(40) for t in range(20)]
    got = tracks.assembled(spark.createDataFrame(rows, "k long, t double, v double"), "k", "t", "v", 5, 3.0, 0.5)
    assert sorted((r.key, r.track, r.points, r.first, r.last) for r in got.collect()) == [(k, 0, 20, 0.0, 19.0) for k in range(40)]
    plan = got.sparkSession.read.format("parquet").load(got.inputFiles()[0].rsplit("/", 1)[0])
    assert len({f for f in plan.inputFiles()}) > 1


@pytest.mark.parametrize("points", [10, 1_000])
def test_clusters_in_one_pass_and_in_rounds_agree(spark, monkeypatch, points):
    """Keys of few points are shuffled once, those of many go through rounds: the same clusters; NaN is near nothing."""
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 2, 3, None]), i, float(rng.randint(0, 900)), float(rng.randint(0, 60))) for i in range(60)] + [(4, 301, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k long, i long, p double, v double").repartition(3)
    want = {tuple(r) for r in tracks.clustered_in_rounds(df.where("k is not null"), "k", "i", "p", "v", 100, 12, 9).collect()}
    monkeypatch.setattr(tracks, "POINTS", points)
    assert {tuple(r) for r in tracks.clustered(df, "k", "i", "p", "v", 100, 12, 9).collect()} == want
    if points == 1_000:
        nan = df.union(spark.createDataFrame([(5, 400, 1.0, float("nan")), (5, 401, 1.0, float("nan"))], df.schema))
        got = tracks.clustered(nan, "k", "i", "p", "v", 100, 12, 9)
        assert {tuple(r) for r in got.collect()} == want | {(5, 0, 1), (5, 1, 1)}
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
