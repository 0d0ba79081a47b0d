"""Greedy selections, made in parallel and equal to the sequential ones.

A greedy pass goes through rows from the best to the worst and keeps a row
unless a kept one conflicts with it. In parallel, every row that no undecided
better row conflicts with is kept at once, the rows in conflict with it go, and
the rest is looked at again until nothing is left: the same rows are kept,
whatever the order in which tasks see them. Each round decides at least the best
row of each neighbourhood and is written to the shared folder, so lineage does
not grow; a round's work is the undecided rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.sources.scratch import written


Near = tuple[str, float] | tuple[str, float, float]


class Dimension:
    """A column, how far apart two conflicting rows are at most, and the period that it wraps round at, if there is one.

    Cells are no wider than the reach, so all rows of one conflict; those round a period divide it evenly, and may be
    down to half as wide.
    """

    def __init__(self, near: Near):
        self.column, self.reach = near[0], float(near[1])
        self.period = float(near[2]) if len(near) > 2 else None
        self.cells = ceil(self.period / self.reach) if self.period else None
        self.width = self.period / self.cells if self.cells else self.reach
        self.steps = (-1, 0, 1) if self.cells is None else (-2, -1, 0, 1, 2) if self.cells >= 5 else tuple(range(self.cells))

    def value(self) -> Column:
        x = F.col(self.column).cast("double")
        return x if self.period is None else F.pmod(x, F.lit(self.period))

    def cell(self) -> Column:
        at = F.floor(self.value() / self.width)
        return at if self.cells is None else F.least(at, F.lit(self.cells - 1))

    def beside(self, cell: Column, step: Column) -> Column:
        return cell + step if self.cells is None else F.pmod(cell + step, F.lit(self.cells))

    def gap(self, x: Column, y: Column) -> Column:
        flat = F.abs(x - y)
        return flat if self.period is None else F.least(flat, F.lit(self.period) - flat)


def suppressed(df: DataFrame, key: str, group: Sequence[str], near: Sequence[Near], order: Sequence[Column], strict: bool = False) -> DataFrame:
    """Rows of df that non-maximum suppression keeps: within a group, no kept row has a better kept one within reach in all of `near` (column, reach, and a period where it wraps round).

    `order` sorts from the best (ascending), the unique `key` breaks ties. Rows that are null in a `near` column
    conflict with none and stay. With strict, a difference of exactly the reach is no conflict.

    No pairs of a group are made. Space is cut into cells of one reach, in which all rows conflict, so at most one row
    of a cell can be next: each undecided row meets the best rows of its own and the adjoining cells, 3 for each
    dimension (5 round a period), however many rows a cell holds.
    """
    axes = [Dimension(n) for n in near]
    cells = [f"__c{i}" for i in range(len(axes))]
    known = reduce(lambda a, b: a & b, [F.col(x.column).isNotNull() for x in axes])
    placed = df.where(known).select(
        F.col(key).alias("__id"), *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), *(x.value().alias(f"__x{i}") for i, x in enumerate(axes)),
        *(x.cell().alias(cell) for x, cell in zip(axes, cells, strict=True)), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(key).alias("id")).alias("__rank"),
    )
    groups = [f"__g{i}" for i in range(len(group))]
    space = [*groups, *cells]
    open_ = written(placed, "selection")
    kept: list[DataFrame] = []
    around = [F.struct(*(F.lit(d).alias(c) for d, c in zip(x, cells, strict=True))) for x in product(*(x.steps for x in axes))]

    def reaching(rows: DataFrame) -> DataFrame:
        """Rows under each cell that they may conflict with: many times the rows that Spark sees, so they are never sent through the driver."""
        named = rows.select(*groups, *cells, *(F.col(f"__x{i}").alias(f"__y{i}") for i in range(len(near))), F.col("__rank").alias("__other"), F.explode(F.array(*around)).alias("__d"))
        return named.select(*groups, *(x.beside(F.col(c), F.col("__d")[c]).alias(c) for x, c in zip(axes, cells, strict=True)), *(f"__y{i}" for i in range(len(near))), "__other").hint("merge")

    def close() -> Column:
        gaps = [(x.gap(F.col(f"__x{i}"), F.col(f"__y{i}")), x.reach) for i, x in enumerate(axes)]
        return reduce(lambda a, b: a & b, [(g < r) if strict else (g <= r) for g, r in gaps])

    while not open_.isEmpty():
        best = open_.groupBy(*space).agg(F.min_by(F.struct(*(f"__x{i}" for i in range(len(near)))), "__rank").alias("__b"), F.min("__rank").alias("__rank"))
        best = best.select(*space, *(F.col("__b")[f"__x{i}"].alias(f"__x{i}") for i in range(len(near))), "__rank")
        # A cell's best row is next if no better row of an adjoining cell conflicts with it.
        beaten = open_.join(reaching(best), space).where(close() & (F.col("__rank") < F.col("__other"))).select(F.col("__other").alias("__rank")).distinct()
        chosen = written(best.join(beaten.hint("merge"), "__rank", "left_anti").select(*best.columns), "selection")
        kept.append(chosen.select(F.col("__rank.id").alias(key)))
        gone = open_.join(reaching(chosen), space).where(close()).select("__id").distinct()
        open_ = written(open_.join(gone.hint("merge"), "__id", "left_anti"), "selection")
    free = df.where(~known)
    if not kept:
        return free
    return df.where(known).join(reduce(DataFrame.union, kept).hint("merge"), key, "left_semi").select(*df.columns).union(free)


def joined(df: DataFrame, key: str, group: Sequence[str], near: Sequence[Near], order: Sequence[Column]) -> DataFrame:
    """(key, leader) of each row: the best of the rows kept by `suppressed` that is within reach of it, itself if it is kept."""
    kept = written(suppressed(df, key, group, near, order), "selection")
    axes = [Dimension(n) for n in near]
    cells = [f"__c{i}" for i in range(len(axes))]
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(key).alias("id"))
    place = lambda rows, x: rows.select(F.col(key).alias(f"__{x}"), *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), *(d.value().alias(f"__{x}{i}") for i, d in enumerate(axes)), *(d.cell().alias(c) for d, c in zip(axes, cells, strict=True)), rank.alias(f"__rank_{x}"))
    around = F.array(*(F.struct(*(F.lit(d).alias(c) for d, c in zip(x, cells, strict=True))) for x in product(*(x.steps for x in axes))))
    leaders = place(kept, "y").withColumn("__d", F.explode(around))
    leaders = leaders.select("__y", *(c for c in leaders.columns if c.startswith("__g")), *(f"__y{i}" for i in range(len(axes))), "__rank_y", *(x.beside(F.col(c), F.col("__d")[c]).alias(c) for x, c in zip(axes, cells, strict=True)))
    close = reduce(lambda a, b: a & b, [x.gap(F.col(f"__x{i}"), F.col(f"__y{i}")) <= x.reach for i, x in enumerate(axes)])
    met = place(df, "x").join(leaders.hint("merge"), [*(f"__g{i}" for i in range(len(group))), *cells]).where(close)
    return met.groupBy(F.col("__x").alias(key)).agg(F.min_by("__y", "__rank_y").alias("leader"))


def matched(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs, taken from the highest score down (ties by the smaller left, then right) while both ends are free.

    Each round takes the pairs that are the best of both their ends, then drops all pairs of these ends. A pair that
    occurs twice counts once, null ends and scores never.
    """
    usable = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(score).isNotNull())
    rank = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    open_ = written(usable.groupBy(left, right).agg(F.max(score).alias(score)).withColumn("__rank", rank), "selection")
    found: list[DataFrame] = []
    while not open_.isEmpty():
        firsts = [open_.groupBy(end).agg(F.min("__rank").alias("__rank")).select("__rank") for end in (left, right)]
        chosen = written(firsts[0].join(firsts[1], "__rank").select("__rank.*"), "selection")
        found.append(chosen.select(F.col("l").alias(left), F.col("r").alias(right), (-F.col("s")).alias(score)))
        rest = open_.join(chosen.select(F.col("l").alias(left)), left, "left_anti").join(chosen.select(F.col("r").alias(right)), right, "left_anti")
        open_ = written(rest.select(left, right, score, "__rank"), "selection")
    return reduce(DataFrame.union, found) if found else usable.select(left, right, score)
