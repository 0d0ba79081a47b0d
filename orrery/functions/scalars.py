"""Scalar functions as Columns; all stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the range of a 12-bit sample.
FULL_SCALE = 2048.0


def wrapped_gap(a: Column, b: Column, period: Column | float) -> Column:
    """The shorter way between a and b on a circle; infinite where either is null."""
    p = period if isinstance(period, Column) else F.lit(period)
    d = F.pmod(a - b, p)
    return F.coalesce(F.least(d, p - d), F.lit(float("inf")))


def decibels(power: Column) -> Column:
    return 10 * F.log10(power)


def dbfs(rms: Column, full_scale: float = FULL_SCALE) -> Column:
    """Level against full scale; null unless the level is positive."""
    return F.when(rms > 0, 20 * F.log10(rms / full_scale))


def finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def half_even(value: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.rint(value)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def from_nanoseconds(ns: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))


def canonical_digest(*fields: str) -> Column:
    """SHA-256 of a JSON object of the fields in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def clean_name(name: Column, suffix: str) -> Column:
    """Trimmed, lower case, without the suffix."""
    return F.regexp_replace(F.lower(F.trim(name)), f"{suffix}$", "")


def safe_identity(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._#-]*$")


def item_or(values: Column, index: Column | int, default: Column | None = None) -> Column:
    """The item at a zero-based index, the default past either end."""
    return F.coalesce(F.get(values, F.lit(index) if isinstance(index, int) else index), F.lit(None) if default is None else default)


def packed_states(value: Column, count: int) -> Column:
    """Two-bit states, lowest bits first."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.call_function("shiftrightunsigned", value, (i * 2).cast("int")).bitwiseAND(F.lit(3).cast("long")))


def guard_band(sample_rate: Column, occupied: float, share: float = 0.5) -> Column:
    """What a sample rate leaves on either side of the occupied band; never below zero."""
    return F.greatest(F.lit(0.0), (sample_rate - occupied) * share)


def linear(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Between two nodes on a line; null outside them."""
    inside = (x >= x0) & (x <= x1)
    return F.when(inside, F.when(x1 > x0, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(y0))


def exponential_score(error: Column, scale: float) -> Column:
    return F.exp(-F.abs(error) / scale)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def exact(value: Column) -> Column:
    """A number as a decimal of ten places: sums of these do not depend on the order of rows."""
    return value.cast("decimal(28,10)")


def exact_mean(value: Column) -> Column:
    """Mean of a group that does not depend on the order of rows."""
    return F.sum(exact(value)).cast("double") / F.count(value)


def summed_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """df with `out`, the sum of the values of its group up to each row, and `out`_place, the row's place.

    Doubles are added one by one in the order, as SQL adds rows that are stored in it, so the last sum is that of SQL to
    the last bit, however the rows are dealt; a group is read row by row and never held.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({out: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), f"{out}_place": F.row_number().over(w)})


def rounded_half_up(value: Column, digits: int) -> Column:
    """As SQL rounds the binary number: scaled, to the nearest whole number, scaled back. F.round rounds its shortest decimal form."""
    return F.round(value * 10.0**digits) / 10.0**digits
