"""Aggregations: order statistics, thresholds from null populations, rates and intervals.

Order statistics never gather a group's values in one task. A mergeable sketch
of each group (map-side combine) gives cuts of about equal numbers of rows,
whatever the values' distribution; two cuts on either side of each place that
is asked for bracket its value. Rows below a bracket are counted where they
are, and only the few rows inside brackets are shuffled, counted by value and
sorted, each bracket as a task's work of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from orrery.sources.scratch import written

Pick = Callable[[Column], Column]


def at_fraction(f: float) -> Pick:
    """Place round(f * (n - 1)), halves to the even place."""
    return lambda n: F.rint(f * (n - 1))


def at_floor(f: float) -> Pick:
    """Place floor(f * (n - 1))."""
    return lambda n: F.floor(f * (n - 1))


#: Cuts of a group, and the sketch's accuracy: places are off by a quarter of what lies between two cuts at most.
CUTS = 1024
ACCURACY = 4 * CUTS


def beside(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b, on equal keys, null ones too; without keys b is one row."""
    if not keys:
        return a.join(F.broadcast(b))
    b = b.withColumnsRenamed({k: f"__b_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in keys]
    return a.join(b, on, how).drop(*(f"__b_{k}" for k in keys))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Pick], count: str | None = "n") -> DataFrame:
    """For each group the values at the picked places of its sorted non-null values, and how many there are.

    Places are counted from 0. Equal values are one entry with its count; NaN is above all numbers.
    """
    rows = df.where(F.col(value).isNotNull())
    kind = rows.schema[value].dataType.simpleString()
    floating = kind in ("double", "float")
    finite = F.when(~F.isnan(value), F.col(value)) if floating else F.col(value)
    cuts = F.percentile_approx(finite, [i / CUTS for i in range(CUTS + 1)], ACCURACY)
    groups = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.count(finite).alias("__finite"), cuts.alias("__cuts"))
    place = {name: p(F.col("__n")) for name, p in picks.items()}
    at = {name: F.floor(c / F.greatest(F.col("__finite"), F.lit(1)) * CUTS) for name, c in place.items()}
    # Places beyond the finite values hold NaN: they have no upper bound.
    brackets = groups.select(*keys, "__n", *(F.struct(
        F.get("__cuts", (at[name] - 2).cast("int")).alias("low"), F.get("__cuts", (at[name] + 3).cast("int")).alias("high"), c.alias("place"),
    ).alias(f"__p_{name}") for name, c in place.items()))
    met = beside(rows.select(*keys, value), brackets, keys)
    v = F.col(value)
    below = {n: F.coalesce(v < F.col(f"__p_{n}.low"), F.lit(False)) for n in picks}
    inside = {n: ~below[n] & F.coalesce(v <= F.col(f"__p_{n}.high"), F.lit(True)) for n in picks}
    bases = met.groupBy(*keys).agg(F.max("__n").alias("__n"), *(F.count_if(below[n]).alias(f"__below_{n}") for n in picks), *(F.max(F.col(f"__p_{n}.place")).alias(f"__place_{n}") for n in picks))
    hit = F.filter(F.array(*(F.when(inside[n], F.lit(n)) for n in picks)), lambda x: x.isNotNull())
    counted = met.select(*keys, value, F.explode(hit).alias("__pick")).groupBy(*keys, "__pick", value).agg(F.count("*").alias("__c"))
    based = beside(counted, bases, keys)
    chosen = lambda what: F.coalesce(*(F.when(F.col("__pick") == n, F.col(f"__{what}_{n}")) for n in picks))
    upto = chosen("below") + F.sum("__c").over(Window.partitionBy(*keys, "__pick").orderBy(value))
    ranked = based.select(*keys, value, "__pick", "__c", "__n", chosen("place").alias("__place"), upto.alias("__upto"))
    found = ranked.where((F.col("__upto") - F.col("__c") <= F.col("__place")) & (F.col("__place") < F.col("__upto")))
    out = [F.max(F.when(F.col("__pick") == n, v)).alias(n) for n in picks]
    return found.groupBy(*keys).agg(*out, *([F.max("__n").alias(count)] if count else []))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles of each group that has a value, and how many values (n)."""
    low = {f"__l{n}": (lambda f: lambda m: F.floor(f * (m - 1)))(f) for n, f in fractions.items()}
    high = {f"__h{n}": (lambda f: lambda m: F.ceil(f * (m - 1)))(f) for n, f in fractions.items()}
    at = order_statistics(df, keys, value, low | high)
    between = lambda n, f: F.col(f"__l{n}") + (F.col(f"__h{n}") - F.col(f"__l{n}")) * (f * (F.col("n") - 1) - F.floor(f * (F.col("n") - 1)))
    return at.select(*keys, *(between(n, f).cast("double").alias(n) for n, f in fractions.items()), "n")


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, p50, p90, p99 and maximum by rounded place."""
    return order_statistics(df, keys, value, {"minimum": at_fraction(0), "p50": at_fraction(0.5), "p90": at_fraction(0.9), "p99": at_fraction(0.99), "maximum": at_fraction(1)})


def distribution(df: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float], digits: int = 6) -> DataFrame:
    """Linearly interpolated percentiles and the mean."""
    means = df.groupBy(*keys).agg(F.round(F.avg(value), digits).alias("mean"))
    at = percentiles(df, keys, value, fractions)
    return beside(means, at, keys, "left").select(*keys, *(F.round(n, digits).alias(n) for n in fractions), "mean")


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, median, minimum and maximum; null where a group has no value."""
    plain = df.groupBy(*keys).agg(F.count(value).alias("count"), F.min(value).alias("minimum"), F.max(value).alias("maximum"))
    at = percentiles(df, keys, value, {"median": 0.5})
    return beside(plain, at, keys, "left").select(*keys, "count", "median", "minimum", "maximum")


#: Cells of a group's values, twice: the second time those of a cell that holds a middle value.
CELLS = 1024


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """The median of each of `values` for each group that has one. Groups are few: a row or two for each is broadcast.

    Equal values are one entry with its count. A group's entries are counted in cells of equal width where they are;
    those of the cells that hold a middle value are counted in cells again, and only what is then left is sorted.
    Infinite values and NaN, the highest, have cells of their own.
    """
    long = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("__what"), c.cast("double").alias("__v")) for n, c in values.items()))).alias("__m")).select(*keys, "__m.*").where("__v IS NOT NULL")
    group, v, lo, hi = [*keys, "__what"], F.col("__v"), F.col("__lo"), F.col("__hi")
    long = written(long.groupBy(*group, "__v").agg(F.count("*").alias("__w")), "medians")
    top = F.lit(float("inf"))
    finite = F.when(F.abs(v) < top, v)
    cell = F.when(F.isnan(v), CELLS + 1).when(v == top, CELLS).when(v == -top, -1).otherwise(F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * CELLS), F.lit(CELLS - 1))).otherwise(0))
    low, high = F.floor((F.col("__n") - 1) / 2), F.ceil((F.col("__n") - 1) / 2)
    held = long.groupBy(*group).agg(F.sum("__w").alias("__n"), F.lit(0).cast("long").alias("__base"), F.min(finite).alias("__lo"), F.max(finite).alias("__hi"))
    for level, by in enumerate((cell, cell, v)):
        met = beside(long, F.broadcast(held), group)
        met = met.where((v >= lo) & (v <= hi)) if level else met
        counted = met.groupBy(*group, "__n", "__base", by.alias("__c")).agg(F.sum("__w").alias("__k"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        upto = F.col("__base") + F.sum("__k").over(Window.partitionBy(*group, "__base").orderBy("__c"))
        held = counted.withColumn("__upto", upto).where((F.col("__upto") - F.col("__k") <= high) & (F.col("__upto") > low)).select(*group, "__n", (F.col("__upto") - F.col("__k")).alias("__base"), "__upto", "__lo", "__hi")
        held = held.drop("__upto") if level < 2 else held
    one, two = F.max(F.when((F.col("__base") <= low) & (low < F.col("__upto")), lo)), F.max(F.when((F.col("__base") <= high) & (high < F.col("__upto")), lo))
    middle = held.groupBy(*group).agg(one.alias("__one"), two.alias("__two")).withColumn("__median", F.when(F.col("__one") == F.col("__two"), F.col("__one")).otherwise(F.col("__one") + (F.col("__two") - F.col("__one")) * 0.5))
    return middle.groupBy(*keys).agg(*(F.max(F.when(F.col("__what") == n, F.col("__median"))).alias(n) for n in values))


def with_medians(groups: DataFrame, df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """groups with the medians of df; null where a group has no value."""
    return beside(groups, medians(df, keys, values), keys, "left")


def medians_of_sets(df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], plain: Callable[[GroupedData], DataFrame], values: dict[str, Column]) -> DataFrame:
    """Grouping sets: the plain aggregates of each group of each set, and its medians; a key that is not in a set is null in it."""
    kinds = {f.name: f.dataType for f in df.schema}
    which = F.array(*(F.struct(F.lit(i).alias("__set"), *((F.col(k) if k in s else F.lit(None).cast(kinds[k])).alias(k) for k in keys)) for i, s in enumerate(sets)))
    each = df.withColumn("__sets", F.explode(which)).select("__sets.*", *(c for c in df.columns if c not in keys))
    return with_medians(plain(each.groupBy("__set", *keys)), each, ["__set", *keys], values).drop("__set")


def null_threshold(nulls: DataFrame, keys: Sequence[str], score: str, false_alarm: float) -> DataFrame:
    """The score at 1 - false_alarm of the null population, the rate it gives there, and whether the population is large enough to say so."""
    at = order_statistics(nulls, keys, score, {"threshold": at_fraction(1 - false_alarm)})
    above = nulls.join(at, list(keys)) if keys else nulls.crossJoin(at)  # one row
    rates = above.groupBy(*keys, "threshold", "n").agg(F.sum((F.col(score) > F.col("threshold")).cast("long")).alias("above"))
    return rates.select(*keys, "threshold", "n", (F.col("above") / F.col("n")).alias("rate"), (3 / F.col("n")).alias("finest"), (3 / F.col("n") <= false_alarm).alias("supported"))


def firing(df: DataFrame, thresholds: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Scored and fired counts and the rate; a group without threshold has a null rate."""
    joined = df.where(F.col(score).isNotNull()).join(thresholds.select(*keys, "threshold"), list(keys), "left")
    fired = F.sum((F.col(score) > F.col("threshold")).cast("long"))
    return joined.groupBy(*keys).agg(F.count("*").alias("scored"), fired.alias("fired")).withColumn("rate", F.col("fired") / F.col("scored"))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The interval of a proportion."""
    p, zz = k / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return centre - half, centre + half


def phi_matrix(decisions: DataFrame, item: str, method: str, fired: str) -> DataFrame:
    """Correlation of the binary decisions of each two methods over the items that both judged."""
    one = decisions.select(item, F.col(method).alias("left"), F.col(fired).cast("int").alias("x"))
    two = decisions.select(item, F.col(method).alias("right"), F.col(fired).cast("int").alias("y"))
    pairs = one.join(two, item).where(F.col("left") < F.col("right"))
    return pairs.groupBy("left", "right").agg(F.count("*").alias("n"), F.corr("x", "y").alias("phi"))


def residual_correlation(df: DataFrame, strata: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of x and y after each stratum's means are taken out."""
    means = df.groupBy(*strata).agg(F.avg(x).alias("__mx"), F.avg(y).alias("__my"))
    rest = df.join(means, list(strata)).select((F.col(x) - F.col("__mx")).alias("x"), (F.col(y) - F.col("__my")).alias("y"))
    return rest.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))


def stratified_difference(df: DataFrame, strata: Sequence[str], group: Column, value: str, least: int) -> DataFrame:
    """Median difference between the groups in each stratum that has `least` of both."""
    per = df.groupBy(*strata).agg(
        F.count(F.when(group, F.col(value))).alias("n_in"), F.count(F.when(~group, F.col(value))).alias("n_out"),
        F.median(F.when(group, F.col(value))).alias("m_in"), F.median(F.when(~group, F.col(value))).alias("m_out"),
    )
    return per.where((F.col("n_in") >= least) & (F.col("n_out") >= least)).withColumn("difference", F.col("m_in") - F.col("m_out"))


#: Ranges of values that sum themselves, at least.
RANGES = 256


def totals_upto(counted: DataFrame, keys: Sequence[str], order: Column, sums: Sequence[str]) -> DataFrame:
    """counted, a row for each group and value, with `__upto_<name>` and `__all_<name>` of each of `sums`: its total over the values up to this one, in the order given, and over all.

    Rows are cut into ranges by group and value; ranges sum themselves and are offset by the ranges before, so no group
    is one task's work.
    """
    n = max(RANGES, int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(counted.repartitionByRange(n, *keys, order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy(*keys, "__range").agg(*(F.sum(s).alias(s) for s in sums))
    alls = {f"__all_{s}": F.sum(s).over(Window.partitionBy(*keys)) for s in sums}
    bases = totals.select(*keys, "__range", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__base_{s}") for s in sums), *(c.alias(a) for a, c in alls.items()))
    met = beside(placed.withColumns({f"__in_{s}": F.sum(s).over(inside) for s in sums}), F.broadcast(bases), [*keys, "__range"])  # a row for each range and group
    return met.select(*counted.columns, *((F.col(f"__base_{s}") + F.col(f"__in_{s}")).alias(f"__upto_{s}") for s in sums), *alls)


def smoothed_exceedance(observed: DataFrame, nulls: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """For each observation (1 + nulls at or above it) / (nulls + 1), by counts of equal scores added up from the highest."""
    rows = lambda df, o: df.select(*keys, F.col(score).alias("s"), F.lit(o).alias("o"))
    both = rows(observed, 1).unionByName(rows(nulls.where(F.col(score).isNotNull()), 0))
    counted = both.groupBy(*keys, "s").agg(F.sum(1 - F.col("o")).alias("__nulls"), F.sum("o").alias("__times"))
    ranked = totals_upto(counted, keys, F.desc("s"), ["__nulls"])
    p = (1 + F.col("__upto___nulls")) / (F.col("__all___nulls") + 1)
    return ranked.where("__times > 0").select(*keys, F.col("s").alias(score), p.alias("p"), F.explode(F.sequence(F.lit(1), "__times"))).drop("col")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties, nulls last."""
    ranked = df.select(*keys, x, y)
    for v in (x, y):
        counted = df.groupBy(*keys, v).agg(F.count("*").alias("__c"))
        rank = F.col("__upto___c") - (F.col("__c") - 1) / 2
        ranked = beside(ranked, totals_upto(counted, keys, F.asc_nulls_last(v), ["__c"]).select(*keys, v, rank.alias(f"__r{v}")), [*keys, v])
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(f"__r{x}", f"__r{y}").alias("rho"))
