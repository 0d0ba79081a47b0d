"""Projections of nested reports to relational rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def probes(reports: DataFrame, checks: str, receivers: str, keep: list[str]) -> DataFrame:
    """One row for each check and receiver: the check's place and fields, the receiver's place and fields; a shorter array gives nulls."""
    rows = reports.select(*keep, F.posexplode(checks).alias("check_index", "__check"))
    deep = rows.select(*keep, "check_index", "__check", F.posexplode_outer(F.col(f"__check.{receivers}")).alias("receiver", "__rx"))
    return deep.select(*keep, "check_index", "receiver", F.col("__check").alias("check"), F.col("__rx").alias("rx"))


def run_id(*fields: str) -> Column:
    """Content-derived identity of a run."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def stamp_date(name: Column) -> Column:
    """The day in a name's stamp (YYYYMMDDTHHMMSSZ); null where there is none."""
    day = F.regexp_extract(name, r"(\d{8})T\d{6}Z", 1)
    return F.when(day != "", F.to_date(day, "yyyyMMdd"))


def status(**tests: Column) -> Column:
    """The first name whose test holds; null tests do not hold."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests.items()):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def tuning_key(channel: Column, region: Column) -> Column:
    return F.concat(F.lit("ch"), channel.cast("string"), F.lit("-"), F.regexp_replace(region, "-edge$", ""))


def receiver_position(label: Column) -> Column:
    """lnb-a, lnb-b, lnb-c ... to R1A1, R1A2, R2A1 ...; null for another label."""
    n = F.ascii(F.regexp_extract(label, "^lnb-([a-z])$", 1)) - 97
    return F.when(label.rlike("^lnb-[a-z]$"), F.concat(F.lit("R"), (F.floor(n / 2) + 1).cast("string"), F.lit("A"), (n % 2 + 1).cast("string")))


def verdict(score: Column, threshold: Column) -> Column:
    """Three-valued: null where no threshold was measured or nothing was scored."""
    return F.when(threshold.isNotNull() & score.isNotNull(), score >= threshold)


def assigned(draw: Column, arms: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, arms)), (F.pmod(draw, F.lit(len(arms))) + 1).cast("int"))
