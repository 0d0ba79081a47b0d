"""Labels exchanged over times: how many draws bring three of one label as close as observed.

A draw is a permutation of the rows' numbers that any task computes for itself,
so no draw is shuffled. Labels of one owner have consecutive numbers. Times lie
in slices of about equal rows, each with what follows it within reach; a slice
finds, for every draw, the few rows that could be three of one owner, by numbers
that are close, and only these meet the owners.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.sources.scratch import written

#: Rows of a slice, about, and slices at most.
SLICE, SLICES = 30_000, 4096
#: Owners that slices know by name: at most so many, of so many labels at least.
KNOWN, LARGE = 4096, 1024


def permuted(i: np.ndarray, n: int, draw: int) -> np.ndarray:
    """Where the draw's permutation of 0 to n - 1 takes i.

    Rounds of multiplying, adding and folding permute the next power of two; what falls beyond n goes round again.
    """
    bits = max(2, (n - 1).bit_length())
    kind = np.uint32 if bits <= 32 else np.uint64  # the low bits of a product are those of the low bits
    mask, half = kind((1 << bits) - 1), kind((bits + 1) // 2)
    keys = (np.random.default_rng([39, draw]).integers(0, 1 << 63, (6, 2), dtype=np.uint64) | np.array([1, 0], np.uint64)).astype(kind)
    out = i.astype(kind)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        for a, b in keys:
            x *= a
            x += b
            x &= mask
            x ^= x >> half
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


def crowded(label: np.ndarray, time: np.ndarray, apart: int, reach: int) -> np.ndarray:
    """The places of rows that share with two others labels less than `apart` apart and times up to `reach` apart, and some more."""
    order = np.argsort(label)
    near = label[order][2:] - label[order][:-2] < apart
    run = np.zeros(len(order), bool)
    for k in range(3):
        run[k : k + len(near)] |= near
    rows = order[run]
    kept = np.zeros(len(rows), bool)
    x, y = label[rows], time[rows] - (time.min() if len(time) else 0)
    for a in (0, apart):
        for b in (0, reach + 1):  # what is close lies whole in a cell of one of the four grids
            cell = (x + a) // (2 * apart) * (int(y.max(initial=0)) // (2 * (reach + 1)) + 2) + (y + b) // (2 * (reach + 1))
            _, which, count = np.unique(cell, return_inverse=True, return_counts=True)
            kept |= count[which] >= 3
    return rows[kept]


def closest(owner: np.ndarray, time: np.ndarray) -> float:
    """The shortest time that holds three rows of one owner."""
    order = np.lexsort((time, owner))
    o, t = owner[order], time[order]
    span = (t[2:] - t[:-2])[o[2:] == o[:-2]]
    return float(span.min()) if len(span) else np.inf


def numbered(owners: DataFrame, key: str) -> DataFrame:
    """(start, labels) of each owner that has three labels or more: ranges of a hash sum themselves and are offset by the ranges before."""
    placed = owners.where("labels >= 3").withColumn("range", F.shiftright(F.xxhash64(key), 56))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("range").agg(F.sum("labels").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.sum("labels").over(Window.partitionBy("range").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = placed.withColumn("upto", inside).join(F.broadcast(bases), "range")  # 256 rows
    return written(out.select((F.col("base") + F.col("upto") - F.col("labels")).cast("long").alias("start"), F.col("labels").cast("long").alias("labels")), "permutation")


def as_close(rows: DataFrame, time: str, tie: str, owners: DataFrame, key: str, reach: int, draws: int) -> set[int]:
    """The draws in which three labels of one owner lie no more than `reach` apart in `time` (whole numbers; null times take labels, too).

    owners: (key, labels). Draws that slices do not decide, because labels are few and the reach is wide, are looked at
    with all their labelled rows.
    """
    spark = rows.sparkSession
    owned = numbered(owners, key)
    total = owned.agg(F.coalesce(F.sum("labels"), F.lit(0)).alias("m")).first()["m"]
    if not total:
        return set()
    large = max(LARGE, -(-total // KNOWN))
    apart = owned.where(F.col("labels") < large).agg(F.coalesce(F.max("labels"), F.lit(3)).alias("c")).first()["c"]
    known = sorted((r.start, r.labels) for r in owned.where(F.col("labels") >= large).collect())  # KNOWN rows at most
    known_start, known_end = np.array([s for s, _ in known], np.int64), np.array([s + c for s, c in known], np.int64)

    n = rows.count()
    t = F.col(time)
    parts = int(min(SLICES, max(1, n // SLICE)))
    cuts = rows.agg(F.percentile_approx(t, [i / parts for i in range(parts + 1)], 4 * SLICES).alias("c")).first()["c"]
    if not cuts:
        return set()
    wide = min(reach, max(1, (cuts[-1] - cuts[0]) // parts))
    edges: list[int] = []  # each slice is at least as wide as what follows it within reach
    for c in cuts[1:-1]:
        if c - (edges[-1] if edges else cuts[0]) > wide:
            edges.append(c)
    slice_of = lambda x: F.size(F.filter(F.lit(edges), lambda e: e <= x)) if edges else F.lit(0)
    placed = rows.where(t.isNotNull()).select(t.cast("long").alias("us"), F.col(tie).alias("tie")).withColumn("slice", slice_of(F.col("us")))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("slice").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("slice").orderBy("us", "tie")) - 1
    index = written(placed.withColumn("inside", inside).join(F.broadcast(bases), "slice").select("slice", "us", (F.col("base") + F.col("inside")).alias("i")), "permutation")  # SLICES rows at most

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        us, i, out = pdf["us"].to_numpy(), pdf["i"].to_numpy(), []
        piece = int(pdf["slice"].iloc[0])
        for draw in range(1, draws + 1):
            label = permuted(i, n, draw)
            on = label < total
            x, y = label[on], us[on]
            if len(known_start):
                k = np.searchsorted(known_start, x, "right") - 1
                told = (k >= 0) & (x < known_end[k])
                if closest(k[told], y[told]) <= wide:
                    out.append(pd.DataFrame({"slice": piece, "draw": draw, "label": [-1], "us": [0]}))
                    continue
                x, y = x[~told], y[~told]
            at = crowded(x, y, apart, wide)
            if len(at):
                out.append(pd.DataFrame({"slice": piece, "draw": draw, "label": x[at], "us": y[at]}))
        return pd.concat(out) if out else pd.DataFrame({"slice": [], "draw": [], "label": [], "us": []}).astype("int64")

    halo = index.withColumn("slice", F.explode(F.sequence(slice_of(F.col("us") - F.lit(wide)), "slice")))
    each = halo.repartition(max(len(edges) + 1, 4 * spark.sparkContext.defaultParallelism), "slice")  # few bytes, much work
    found = written(each.groupBy("slice").applyInPandas(search, "slice long, draw long, label long, us long"), "permutation")
    sure = {r.draw for r in found.where("label < 0").select("draw").distinct().collect()}  # draws
    sure |= met(found.where("label >= 0"), owned, apart, ["slice", "draw"], wide)
    left = sorted(set(range(1, draws + 1)) - sure)
    if not left or wide >= reach:
        return sure

    def labelled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            us, i = pdf["us"].to_numpy(), pdf["i"].to_numpy()
            for draw in left:
                label = permuted(i, n, draw)
                on = label < total
                yield pd.DataFrame({"draw": draw, "label": label[on], "us": us[on]})

    return sure | met(index.mapInPandas(labelled, "draw long, label long, us long"), owned, large, ["draw"], reach)


def met(rows: DataFrame, owned: DataFrame, block: int, keys: Sequence[str], reach: int) -> set[int]:
    """The draws in which three rows of an owner and of equal keys lie within reach; labels meet owners in blocks of numbers."""
    at = lambda x: F.floor(x / F.lit(block))
    owners = owned.withColumn("block", F.explode(F.sequence(at(F.col("start")), at(F.col("start") + F.col("labels") - 1))))
    own = rows.withColumn("block", at(F.col("label"))).join(owners.hint("merge"), "block").where("label >= start AND label < start + labels")
    span = F.lead("us", 2).over(Window.partitionBy(*keys, "start").orderBy("us")) - F.col("us")
    return {r.draw for r in own.withColumn("span", span).where(F.col("span") <= reach).select("draw").distinct().collect()}  # draws
