"""Order-dependent steps, cut into pieces that do not depend on each other: no key is one task's work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.operators.selection import joined
from orrery.sources.scratch import written


#: A key of more points is clustered in rounds by all cores, others each in one pass of one task.
POINTS = 200_000


def clustered(df: DataFrame, key: str, order: str, position: str, value: str, period: float, near: float, tolerance: float) -> DataFrame:
    """(key, cluster, points): each point joins the first representative within both tolerances, round the period, else opens a cluster.

    Points are shuffled once, by key, and a task goes through its keys in the order of `order` (unique), holding the
    representatives of one. In a key of more than POINTS points a greedy selection in that order is made in parallel over
    cells of position and value. Points without position or value are no points.
    """
    points = df.where(F.col(key).isNotNull() & F.col(position).isNotNull() & F.col(value).isNotNull()).select(*dict.fromkeys((key, order, position, value)))
    large = written(points.groupBy(key).count().where(F.col("count") > POINTS).select(key), "clusters")  # a row for each POINTS points at most
    many = not large.isEmpty()
    small = points.join(F.broadcast(large), key, "left_anti") if many else points
    placed = small.select(F.col(key).cast("long").alias("key"), F.col(order).alias("order"), F.pmod(F.col(position).cast("double"), F.lit(float(period))).alias("p"), F.col(value).cast("double").alias("v"))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whose, n, p, v, sizes = None, 0, np.empty(64), np.empty(64), []
        for pdf in parts:
            out: list[tuple] = []
            for k, x, y in zip(pdf["key"].to_numpy().tolist(), pdf["p"].to_numpy().tolist(), pdf["v"].to_numpy().tolist(), strict=True):
                if k != whose:
                    out += [(whose, i, c) for i, c in enumerate(sizes)]
                    whose, n, sizes = k, 0, []
                off = np.abs(p[:n] - x)
                hit = (np.minimum(off, period - off) <= near) & (np.abs(v[:n] - y) <= tolerance)
                first = int(hit.argmax()) if n else 0
                if n and hit[first]:
                    sizes[first] += 1
                    continue
                if n == len(p):
                    p, v = np.concatenate([p, np.empty(n)]), np.concatenate([v, np.empty(n)])
                p[n], v[n] = x, y
                n += 1
                sizes.append(1)
            yield pd.DataFrame(out, columns=["key", "cluster", "points"])
        yield pd.DataFrame([(whose, i, c) for i, c in enumerate(sizes)], columns=["key", "cluster", "points"])

    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)  # few bytes, much work
    sizes = placed.repartition(n, "key").sortWithinPartitions("key", "order").drop("order").mapInPandas(scan, "key long, cluster long, points long")
    return sizes.union(clustered_in_rounds(points.join(F.broadcast(large), key, "left_semi"), key, order, position, value, period, near, tolerance)) if many else sizes


def clustered_in_rounds(points: DataFrame, key: str, order: str, position: str, value: str, period: float, near: float, tolerance: float) -> DataFrame:
    """What `clustered` gives: a point opens a cluster unless an earlier representative is near."""
    led = joined(points, order, [key], [(position, near, period), (value, tolerance)], [])
    sizes = led.groupBy("leader").agg(F.count("*").alias("points"))
    owned = sizes.join(points.select(F.col(order).alias("leader"), F.col(key).cast("long").alias("key")), "leader")
    place = F.row_number().over(Window.partitionBy("key").orderBy("leader")) - 1  # a row for each cluster
    return owned.select("key", place.cast("long").alias("cluster"), "points")


def sessions(df: DataFrame, key: str, time: str, gap: float, width: float | None = None) -> DataFrame:
    """df with `session`: a number for each run of a key's rows without a step of more than `gap` in `time` between two of them.

    Steps are looked at inside stretches of time; stretches tell each other their ends, and how many runs begin in them,
    in one row each, so a key's rows never meet in one task.
    """
    width = width or 64 * gap
    rows = df.withColumn("__stretch", F.floor(F.col(time) / width))
    ends = rows.groupBy(key, "__stretch").agg(F.min(time).alias("__a"), F.max(time).alias("__b"))
    by_key = Window.partitionBy(key).orderBy("__stretch")
    opens = F.coalesce(F.col("__a") - F.lag("__b").over(by_key) > gap, F.lit(True)).cast("int")
    inside = Window.partitionBy(key, "__stretch").orderBy(time)
    stepped = rows.withColumn("__step", F.coalesce(F.col(time) - F.lag(time).over(inside) > gap, F.lit(False)).cast("int"))
    begun = stepped.groupBy(key, "__stretch").agg(F.sum("__step").alias("__in"))
    told = ends.join(begun, [key, "__stretch"]).withColumn("__open", opens)
    before = F.sum(F.col("__open") + F.col("__in")).over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__in")
    based = told.select(key, "__stretch", before.alias("__base"))
    own = F.sum("__step").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn("__own", own).join(based, [key, "__stretch"]).withColumn("session", (F.col("__base") + F.col("__own")).cast("long")).drop("__stretch", "__step", "__own", "__base")


def followed(t: np.ndarray, v: np.ndarray, gap: float, base: float, slope: float) -> list[list[int]]:
    """The places of each track's points, tracks in the order in which they open; points are sorted by time, then value.

    A point meets all open tracks at once; what a track foretells is worked out when a point joins it, and closed tracks
    are dropped as their room is needed.
    """
    found: list[list[int]] = []
    last, at, level, rate, who = (np.empty(16) for _ in range(5))
    n = 0
    for i in range(len(t)):
        dt = t[i] - last[:n]
        off = np.abs(level[:n] + rate[:n] * (t[i] - at[:n]) - v[i])
        off[~((dt > 0) & (dt <= gap) & (off <= base + slope * dt))] = np.inf
        k = int(off.argmin()) if n else -1
        if n == 0 or off[k] == np.inf:
            if n == len(last):
                live = np.flatnonzero(dt <= gap)
                n, room = len(live), 2 * len(last) if 2 * len(live) > len(last) else len(last)
                last, at, level, rate, who = (np.concatenate([x[live], np.empty(room - n)]) for x in (last, at, level, rate, who))
            k, n = n, n + 1
            who[k] = len(found)
            found.append([])
        own = found[int(who[k])]
        own.append(i)
        x, y = t[own[-6:]], v[own[-6:]]
        last[k], at[k], level[k] = t[i], x.mean(), y.mean()
        rate[k] = ((x - at[k]) * (y - level[k])).sum() / max(((x - at[k]) ** 2).sum(), 1e-12) if len(x) > 1 else 0.0
    return found


def assembled(df: DataFrame, key: str, time: str, value: str, gap: float, base: float, slope: float, least: int = 2) -> DataFrame:
    """(key, track, points, first, last, drift): each point joins the open track whose last-six-point line foretells it best, else opens one.

    No track goes on over a step of more than `gap`, so each session of a key is a piece of its own; a task goes through
    its sessions in order and holds the points of one.
    """
    names = ["key", "session", "i", "points", "first", "last", "drift"]

    def rows(whose: tuple[int, int], t: np.ndarray, v: np.ndarray) -> list[tuple]:
        out: list[tuple] = []
        for own in followed(t, v, gap, base, slope):
            if len(own) >= least:
                x, y = t[own], v[own]
                out.append((*whose, len(out), len(own), x[0], x[-1], ((x - x.mean()) * (y - y.mean())).sum() / max(((x - x.mean()) ** 2).sum(), 1e-12)))
        return out

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        whose: tuple[int, int] | None = None
        done = lambda: rows(whose, *(np.concatenate(c) for c in zip(*held, strict=True)))
        for pdf in parts:
            k, s, t, v = (pdf[c].to_numpy() for c in (key, "session", time, value))
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (s[1:] != s[:-1])) + 1
            out: list[tuple] = []
            for a, b in zip([0, *cuts], [*cuts, len(k)], strict=True):
                if a == b:
                    continue
                if held and whose != (k[a], s[a]):
                    out += done()
                    held = []
                whose = (k[a], s[a])
                held.append((t[a:b], v[a:b]))
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(done(), columns=names)

    points = df.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull())
    points = points.select(F.col(key).cast("long").alias(key), F.col(time).cast("double").alias(time), F.col(value).cast("double").alias(value))
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)  # few bytes, much work
    pieces = sessions(points, key, time, gap).repartition(n, key, "session").sortWithinPartitions(key, "session", time, value)
    found = pieces.mapInPandas(build, "key long, session long, i long, points long, first double, last double, drift double")
    found = written(found, "tracks")
    place = F.row_number().over(Window.partitionBy("key").orderBy("session", "i")) - 1  # a row for each track
    return found.select("key", place.cast("long").alias("track"), "points", "first", "last", "drift")


def poisson_bounds(count: Column, share: float = 0.95) -> Column:
    """(low, high): the exact interval of a Poisson mean, by halving on the distribution's own sum."""

    @F.pandas_udf("low double, high double")
    def bounds(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tail = (1 - share) / 2

        def below(k: int, mean: float) -> float:
            terms = np.arange(k + 1)
            logs = terms * np.log(max(mean, 1e-300)) - mean - np.concatenate([[0.0], np.cumsum(np.log(terms[1:]))])
            return float(np.exp(logs).sum())

        def solve(k: int, target: float) -> float:
            low, high = 0.0, k + 10 * np.sqrt(k + 1) + 20
            for _ in range(80):
                mid = (low + high) / 2
                low, high = (mid, high) if below(k, mid) > target else (low, mid)
            return (low + high) / 2

        for counts in parts:
            known = {k: (0.0 if k == 0 else solve(k - 1, 1 - tail), solve(k, tail)) for k in set(counts.astype(int))}
            yield pd.DataFrame([known[int(k)] for k in counts], columns=["low", "high"])

    return bounds(count)
