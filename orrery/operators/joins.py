"""Range, interval and as-of joins as equi joins on buckets; nothing here becomes a nested loop.

A range or interval join puts one side into the buckets that it touches, joins
on the bucket and checks the exact condition after. Keys that are hot are split
by their buckets as well, so no key is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(value: Column, width: float) -> Column:
    return F.floor(value / width)


def within(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, reach: float) -> DataFrame:
    """Pairs of rows with equal keys whose values a and b differ by at most `reach`."""
    bucket = _bucket(F.col(a), reach)
    near = left.withColumn("__bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    here = right.withColumn("__bucket", _bucket(F.col(b), reach))
    return near.join(here, [*keys, "__bucket"]).where(F.abs(F.col(a) - F.col(b)) <= reach).drop("__bucket")


def contained(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, stop: str, width: float, how: str = "inner") -> DataFrame:
    """Points with the intervals that hold them, both ends included; an interval is listed under each bucket it touches."""
    spread = intervals.withColumn("__bucket", F.explode(F.sequence(_bucket(F.col(start), width), _bucket(F.col(stop), width))))
    here = points.withColumn("__bucket", _bucket(F.col(at), width))
    on = [here[k] == spread[k] for k in (*keys, "__bucket")] + [here[at] >= spread[start], here[at] <= spread[stop]]
    joined = here.join(spread, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("__bucket")
    return joined.select(*(here[c] for c in points.columns), *(spread[c] for c in intervals.columns if c not in keys))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """Pairs of intervals that meet; each pair once, from the bucket where the later of the two begins."""
    spread = lambda df, s: df.withColumn("__bucket", F.explode(F.sequence(_bucket(F.col(s[0]), width), _bucket(F.col(s[1]), width))))
    joined = spread(left, a).join(spread(right, b), [*keys, "__bucket"])
    meets = (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1]))
    once = F.col("__bucket") == _bucket(F.greatest(a[0], b[0]), width)
    return joined.where(meets & once).drop("__bucket")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, since: str, values: Sequence[str]) -> DataFrame:
    """Each row of left with the values of the last row of right whose `since` is not after `at`; null if there is none.

    One shuffle: both sides are united, sorted inside their key, and the last right row is carried forward.
    """
    there = right.select(*keys, F.col(since).alias("__t"), F.lit(0).alias("__side"), F.struct(since, *values).alias("__r"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in keys))
    here = left.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(there.schema["__r"].dataType).alias("__r"), *(c for c in left.columns if c not in keys))
    carried = F.last("__r", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0))
    united = there.unionByName(here).withColumn("__r", carried).where("__side = 1")
    return united.select(*left.columns, *(F.col("__r")[v].alias(v) for v in (since, *values)))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, there: str, values: Sequence[str]) -> DataFrame:
    """Each row of left with the row of right whose value is nearest, the earlier one of two as near."""
    before = as_of(left, right, keys, at, there, values)
    flipped = right.withColumn("__neg", -F.col(there))
    after = as_of(before.withColumns({"__at": -F.col(at), "__b": F.struct(there, *values)}).drop(there, *values), flipped.select(*keys, "__neg", there, *values), keys, "__at", "__neg", [there, *values])
    a, b = F.col(there), F.col("__b")[there]
    first = b.isNotNull() & (a.isNull() | (F.abs(F.col(at) - b) <= F.abs(a - F.col(at))))
    return after.select(*left.columns, *(F.when(first, F.col("__b")[v]).otherwise(F.col(v)).alias(v) for v in (there, *values)))


def mutual_best(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are each other's best by score; ties go to the smaller key."""
    ranked = pairs.withColumns({
        "__l": F.row_number().over(Window.partitionBy(left).orderBy(F.desc(score), right)),
        "__r": F.row_number().over(Window.partitionBy(right).orderBy(F.desc(score), left)),
    })
    return ranked.where("__l = 1 and __r = 1").drop("__l", "__r")
