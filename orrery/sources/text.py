"""Text sources: two-line element catalogues and NMEA logs as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed value: the letters of catalogue numbers, in order.
LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"


def element_checksum(line: Column) -> Column:
    """Sum of the digits, a minus counting one, of the first 68 characters, modulo 10."""
    body = F.substring(line, 1, 68)
    digits = F.aggregate(F.split(F.regexp_replace(body, "[^0-9-]", ""), ""), F.lit(0), lambda s, c: s + F.when(c == "-", 1).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))))
    return digits % 10


def catalogue_number(field: Column) -> Column:
    """Five digits, or a letter (without I and O) that stands for two digits before four."""
    first, rest = F.substring(field, 1, 1), F.substring(field, 2, 4)
    alpha = F.call_function("locate", first, F.lit(LETTERS))
    return F.when(first.rlike("[A-Z]"), (alpha + 9) * 10000 + rest.try_cast("int")).otherwise(F.trim(field).try_cast("int"))


def element_sets(texts: DataFrame, text: str = "value", source: str = "source") -> DataFrame:
    """One row for each pair of element lines of each text: name, lines, number, epoch; `reason` is set where a set is quarantined."""
    lines = texts.select(source, F.posexplode(F.split(text, "\r?\n")).alias("at", "line"))
    w = Window.partitionBy(source).orderBy("at")
    near = lines.withColumns({"second": F.lead("line").over(w), "before": F.lag("line").over(w)}).where(F.col("line").startswith("1 "))
    one, two = F.rpad("line", 69, " "), F.rpad(F.coalesce("second", F.lit("")), 69, " ")
    year, day = F.substring(one, 19, 2).try_cast("int"), F.substring(one, 21, 12).try_cast("double")
    whole_year = F.when(year < 57, year + 2000).otherwise(year + 1900)
    first = F.make_timestamp_ntz(whole_year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    epoch = F.timestamp_add("MICROSECOND", F.rint((day - 1) * 86_400e6).cast("long"), first)
    numbers = catalogue_number(F.substring(one, 3, 5)), catalogue_number(F.substring(two, 3, 5))
    reason = F.when(~F.coalesce(F.col("second").startswith("2 "), F.lit(False)), "no second line").when(F.coalesce(numbers[0] != numbers[1], F.lit(True)), "numbers differ").when((element_checksum(one) != F.substring(one, 69, 1).try_cast("int")) | (element_checksum(two) != F.substring(two, 69, 1).try_cast("int")), "checksum").when(year.isNull() | day.isNull(), "epoch")
    name = F.when(~F.col("before").rlike("^[12] "), F.trim("before"))
    return near.select(source, name.alias("name"), F.col("line").alias("line1"), F.col("second").alias("line2"), numbers[0].alias("number"), F.when(reason.isNull(), epoch).alias("epoch"), reason.alias("reason"))


def nmea(lines: DataFrame, line: str = "value") -> DataFrame:
    """kind, fields, and whether the checksum holds, of each sentence."""
    body = F.regexp_extract(line, r"^\$([^*]*)\*[0-9A-Fa-f]{2}\s*$", 1)
    said = F.conv(F.regexp_extract(line, r"\*([0-9A-Fa-f]{2})\s*$", 1), 16, 10).cast("int")
    sum_ = F.aggregate(F.transform(F.split(body, ""), lambda c: F.ascii(c)), F.lit(0), lambda s, x: s.bitwiseXOR(x))
    fields = F.split(body, ",")
    return lines.select("*", F.substring(F.get(fields, F.lit(0)), -3, 3).alias("kind"), fields.alias("fields"), ((body != "") & (sum_ == said)).alias("valid"))


def _degrees(value: Column, hemisphere: Column) -> Column:
    """Degrees of a field of whole degrees and minutes (ddmm.mmmm), negative to the south and west."""
    raw = value.try_cast("double")
    whole = F.floor(raw / 100)
    return (whole + (raw - 100 * whole) / 60) * F.when(hemisphere.isin("S", "W"), -1).otherwise(1)


def latest_fix(lines: DataFrame, keys: Sequence[str], order: str, line: str = "value") -> DataFrame:
    """Of each log its last valid RMC sentence (time and place) and its last GGA sentence with a fix (quality).

    Sentences count by `order`, not by their own time; those of a wrong checksum, a void status or no date do not count.
    A log without a valid RMC has no row; one without a GGA has nulls for quality, satellites, hdop and altitude. Partial
    maxima meet in one row for each log, so no log is gathered or sorted.
    """
    f = lambda i: F.get("fields", F.lit(i))
    said = nmea(lines, line).where(F.col("valid") & (F.size("fields") >= 10))
    two = lambda i, at: F.substring(f(i), at, 2)
    century = F.when(two(9, 5) >= "69", "19").otherwise("20")
    stamp = F.concat(century, two(9, 5), F.lit("-"), two(9, 3), F.lit("-"), two(9, 1), F.lit(" "), two(1, 1), F.lit(":"), two(1, 3), F.lit(":"), two(1, 5)).try_cast("timestamp_ntz")
    timed = (F.col("kind") == "RMC") & (f(2) == "A") & f(9).rlike("^[0-9]{6}$") & f(1).rlike("^[0-9]{6}([.][0-9]*)?$") & stamp.isNotNull()
    micros = F.rpad(F.substring(F.regexp_extract(f(1), "[.]([0-9]*)", 1), 1, 6), 6, "0").cast("int")
    place = F.when(timed, F.struct(order, F.timestamp_add("MICROSECOND", micros, stamp).alias("gps"), _degrees(f(3), f(4)).alias("latitude"), _degrees(f(5), f(6)).alias("longitude"), F.get("fields", F.lit(12)).alias("mode")))
    fixed = (F.col("kind") == "GGA") & ~f(6).isin("", "0")
    number = lambda i, kind: f(i).try_cast(kind)
    quality = F.when(fixed, F.struct(order, number(6, "int").alias("quality"), F.coalesce(number(7, "int"), F.lit(0)).alias("satellites"), number(8, "double").alias("hdop"), number(9, "double").alias("altitude_m")))
    last = said.groupBy(*keys).agg(F.max(place).alias("rmc"), F.max(quality).alias("gga")).where(F.col("rmc").isNotNull())
    return last.select(*keys, "rmc.gps", "rmc.latitude", "rmc.longitude", "rmc.mode", "gga.quality", "gga.satellites", "gga.hdop", "gga.altitude_m")
