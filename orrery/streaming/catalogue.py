"""Catalogue snapshots as they arrive: checked, and published once under the digest of what they hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.currency import first_reason
from orrery.sources.scratch import exists, written

#: What names a delivery of a snapshot.
NAMED = ["source", "scope", "retrieved"]
ENTRY = "source string, scope string, retrieved timestamp_ntz, digest string, sets long, refused string"


def checked(sets: DataFrame, least: int, most: int, age_s: float) -> DataFrame:
    """(source, scope, retrieved, digest, sets, refused) of each delivery: a digest that does not depend on its rows' order, and the first reason against it.

    Refused are deliveries with too few or too many sets, with a number that occurs twice, without a number or an epoch,
    or whose newest epoch is older than age_s when they were retrieved.
    """
    each = F.sha2(F.concat_ws("|", F.coalesce(F.col("number").cast("string"), F.lit("")), F.coalesce(F.col("epoch").cast("string"), F.lit("")), "line1", "line2"), 256)
    mass = [F.sum(F.conv(F.substring(each, at, 12), 16, 10).cast("decimal(20,0)")) for at in (1, 13, 25)]
    g = sets.groupBy(*NAMED).agg(
        F.count("*").alias("sets"), F.count_distinct("number").alias("numbers"), F.count_if(F.col("number").isNull() | F.col("epoch").isNull()).alias("lacking"), F.max("epoch").alias("newest"),
        F.sha2(F.concat_ws("|", F.count("*").cast("string"), *(m.cast("string") for m in mass)), 256).alias("digest"),
    )
    old = F.timestamp_diff("SECOND", F.col("newest"), F.col("retrieved")) > age_s
    why = first_reason(**{"too few": F.col("sets") < least, "too many": F.col("sets") > most, "incomplete": F.col("lacking") > 0, "repeated numbers": F.col("numbers") < F.col("sets"), "stale": F.coalesce(old, F.lit(True))})
    return g.select(*NAMED, "digest", "sets", why.alias("refused"))


def publisher(root: str, least: int, most: int, age_s: float) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for (source, scope, retrieved, number, epoch, line1, line2), whole deliveries at a time.

    `root/content` holds each accepted content once, whole in one file, in the folder of its digest's first two letters:
    the number of files grows with batches, not with contents. `root/entries` has a row for each delivery, refused ones
    with their reason. Content is written before its entry, and both only where there is none yet: a batch or a snapshot
    that is delivered again, or a sink that died on the way, changes nothing.
    """

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        told = checked(batch.distinct(), least, most, age_s)
        if exists(spark, f"{root}/entries"):
            known = spark.read.schema(ENTRY).parquet(f"{root}/entries")
            told = told.join(known, [*NAMED, "digest"], "left_anti")
        told = written(told.select(*(c.split()[0] for c in ENTRY.split(", "))), "entries")
        if told.isEmpty():
            return
        first = told.where("refused is null").groupBy("digest").agg(F.min(F.struct(*NAMED)).alias("d")).select("digest", "d.*")
        if exists(spark, f"{root}/content"):  # a digest is in one file, which is there or is not
            first = first.join(spark.read.schema("digest string").parquet(f"{root}/content").select("digest").distinct(), "digest", "left_anti")
        first = written(first, "entries")
        content = batch.distinct().join(F.broadcast(first) if first.count() < 1000 else first, NAMED).select("digest", "number", "epoch", "line1", "line2")
        folders = content.withColumn("part", F.concat(F.lit("d"), F.substring("digest", 1, 2))).repartition("part")
        folders.write.mode("append").partitionBy("part").parquet(f"{root}/content")
        told.write.mode("append").parquet(f"{root}/entries")

    return sink
