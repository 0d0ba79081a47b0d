"""Nested JSON reports: an explicit contract, probe rows, partitioned tables that are rebuilt only where sources moved."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import currency, project
from orrery.sources.scratch import remove, written

MATCH = "struct<exact_match:struct<frequency_offset_hz:double,epoch_sample:bigint,score:double>,match_score_margin:double>"
#: The read contract of a capture report.
REPORT = f"""
    capture_manifest struct<identity:struct<radio_id:string,serial:string,receiver_labels:array<string>>,metadata:struct<channel_number:int,region:string,observation_mode:string>,created_utc_ns:bigint,gain_mode:string,sample_statistics:struct<receivers:array<struct<rms_magnitude:double,near_full_scale_fraction:double>>>>,
    exact_checks array<struct<start_s:double,candidate:boolean,qualified:boolean,cfo_difference_hz:double,receiver_candidates:array<boolean>,receiver_qualified:array<boolean>,receivers:array<struct<acquisition:{MATCH}>>>>,
    lnb_calibration struct<applied:boolean,reason:string>"""
#: Fields that a report must have; a missing one reads as null, so it is asserted.
REQUIRED = ("capture_manifest.identity.radio_id", "capture_manifest.created_utc_ns", "exact_checks")


def read_reports(spark: SparkSession, path: str | Sequence[str], schema: str = REPORT, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Reports with their file name; a document of another shape, or without a required field, fails the job."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    missing = currency.all_reasons(**{r: F.col(r).isNull() for r in required})
    checked = F.when(F.size(missing) == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("report lacks "), F.array_join(missing, ", "), F.lit(": "), F.col("path"))).cast("boolean"))
    return rows.where(checked)


def probe_rows(reports: DataFrame) -> DataFrame:
    """One row for each probe and receiver; arrays that are too short give nulls."""
    m = F.col("capture_manifest")
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    checks = reports.select(name.alias("recording"), m["identity"].alias("identity"), m["metadata"].alias("metadata"), m["gain_mode"].alias("gain_mode"), m["created_utc_ns"].alias("created_utc_ns"), m["sample_statistics"]["receivers"].alias("levels"), F.posexplode("exact_checks").alias("probe", "c"))
    rx = checks.withColumn("receiver", F.explode(F.sequence(F.lit(0), F.greatest(F.size("identity.receiver_labels"), F.lit(1)) - 1)))
    at = lambda c: F.get(c, F.col("receiver"))
    match = at(F.col("c.receivers"))["acquisition"]
    return rx.select(
        "recording", project.stamp_date(F.col("recording")).alias("date"), "probe", "receiver", F.col("identity.radio_id").alias("radio_id"), at(F.col("identity.receiver_labels")).alias("label"),
        F.col("metadata.channel_number").alias("channel"), F.col("metadata.region").alias("region"), "gain_mode", "created_utc_ns", F.col("c.start_s").alias("start_s"), F.col("c.candidate").alias("candidate"), F.col("c.qualified").alias("qualified"),
        at(F.col("c.receiver_candidates")).alias("receiver_candidate"), at(F.col("c.receiver_qualified")).alias("receiver_qualified"), F.col("c.cfo_difference_hz").alias("cfo_difference_hz"),
        match["exact_match"]["frequency_offset_hz"].alias("offset_hz"), match["exact_match"]["epoch_sample"].alias("epoch_sample"), match["exact_match"]["score"].alias("score"), match["match_score_margin"].alias("margin"),
        at(F.col("levels"))["rms_magnitude"].alias("rms"), at(F.col("levels"))["near_full_scale_fraction"].alias("near_full_scale"),
    )


def write_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Zstandard Parquet in one directory for each key; only the partitions that df holds are replaced.

    Adaptive execution joins the parts of small keys and splits those of large ones, so files follow the data's size.
    """
    df.hint("rebalance", *(F.col(k) for k in keys)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """All partitions by column name; columns that a partition lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of every report; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def digests(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths) if not isinstance(paths, str) else paths).select("path", F.sha2("content", 256).alias("sha256"))


LEDGER = "path string, length bigint, modified timestamp, date date, sha256 string"
#: One row for each partition that a build wrote, appended once its rows are there.
MARKER = "date date, sources bigint, sources_digest string, rows bigint, nulls map<string,bigint>, excluded bigint, written timestamp"
#: A row for each report that no day holds, as of a build.
EXCLUDED = "path string, build bigint"
#: Names that the driver holds at once.
NAMES = 10_000


def recorded(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What was recorded so far; nothing before the first build."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def sources_digest(rows: DataFrame) -> DataFrame:
    """(date, sources, sources_digest) of the signatures of each day's sources."""
    each = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), "sha256"), 256)
    # The sum of the digests' leading bits does not depend on their order, and no day's sources are gathered.
    total = F.sum(F.conv(F.substring(each, 1, 12), 16, 10).cast("decimal(20,0)"))
    return rows.groupBy("date").agg(F.count("*").alias("sources"), F.sha2(total.cast("string"), 256).alias("sources_digest"))


def markers(spark: SparkSession, path: str) -> DataFrame:
    """The newest commit marker of each partition."""
    newest = recorded(spark, path, MARKER).groupBy("date").agg(F.max_by(F.struct("sources", "sources_digest", "rows", "nulls", "excluded", "written"), "written").alias("m"))
    return newest.select("date", "m.*")


def partition_status(spark: SparkSession, marker: str, ledger: str) -> DataFrame:
    """(date, state): a partition is current if its newest marker was written for just the sources of the ledger."""
    now = sources_digest(newest_sources(spark, ledger)).select("date", F.col("sources_digest").alias("__now"))
    both = now.join(markers(spark, marker), "date", "full_outer")
    state = F.when(F.col("__now").isNull() & (F.col("rows") == 0), "gone").when(F.col("sources_digest").isNull(), "unwritten").when(F.col("__now") == F.col("sources_digest"), "current").otherwise("stale")
    return both.select("date", state.alias("state"))


def newest_sources(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's newest row of each source that is still there; a row without a digest says that a source went."""
    rows = recorded(spark, ledger, LEDGER + ", build bigint")
    newest = rows.groupBy("path").agg(F.max_by(F.struct("length", "modified", "date", "sha256"), "build").alias("s")).select("path", "s.*")
    return newest.where("sha256 is not null")


def excluded(spark: SparkSession, marker: str) -> DataFrame:
    """(path) of all reports that no day held at the last build that wrote markers."""
    rows = recorded(spark, f"{marker.rstrip('/')}-excluded", EXCLUDED)
    return rows.join(rows.agg(F.max("build").alias("build")), "build").where("path is not null").select("path")


def chunks(names: DataFrame, *first: str) -> Iterator[list]:
    """Rows of (path, ...), NAMES or so at a time; rows alike in `first` stay together."""
    held: list = []
    for r in names.orderBy(*first, "path").toLocalIterator():
        if len(held) >= NAMES and (not first or tuple(r[c] for c in first) != tuple(held[-1][c] for c in first)):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def build(spark: SparkSession, reports: str, table: str, ledger: str, marker: str | None = None) -> int:
    """Rebuild the days whose reports moved. How many days were rebuilt.

    Two tiers tell what moved: lengths and times of all reports first, digests of those that differ next; a report whose
    digest is the recorded one was only touched. Just the reports of stale days are parsed. A day that lost a report is
    stale, too, and a day without reports loses its partition. Data is written first, then the marker of each day (rows,
    nulls by column, sources, how many reports no day holds, whose names are in `excluded`), then the ledger, so a build that dies is done again.
    """
    marker = marker or f"{ledger.rstrip('/')}-markers"
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    try:
        now = signatures(spark, reports).withColumn("date", project.stamp_date(name))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        now = spark.createDataFrame([], "path string, length bigint, modified timestamp, date date")
    old = newest_sources(spark, ledger)
    then = old.select("path", F.struct("length", "modified").alias("__s"), "sha256", F.col("date").alias("__date"))
    told = now.join(then, "path", "full_outer").select("path", "length", "modified", F.coalesce("date", "__date").alias("date"), F.col("sha256").alias("known"), F.col("length").isNull().alias("gone"), F.coalesce(F.struct("length", "modified") == F.col("__s"), F.lit(False)).alias("same"))
    told = written(told, "sources")
    differ = told.where(~F.col("same") & ~F.col("gone"))
    parts = [written(digests(spark, [r.path for r in names]), "digests") for names in chunks(differ.select("path"))]
    if not parts and told.where("gone").isEmpty():
        return 0
    fresh_digests = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "path string, sha256 string")
    seen = written(differ.join(fresh_digests, "path"), "moved")
    moved = seen.where("known is null or known <> sha256").select("path", "date").union(told.where("gone").select("path", "date"))
    days = [r.date for r in moved.where("date is not null").select("date").distinct().collect()]  # days to rebuild
    number = (recorded(spark, ledger, LEDGER + ", build bigint").agg(F.max("build").alias("b")).first().b or 0) + 1
    kept = told.where("same").select("path", "length", "modified", "date", F.col("known").alias("sha256")).union(seen.select("path", "length", "modified", "date", "sha256"))
    here = kept.where(F.col("date").isin(days))
    for names in chunks(here.select("date", "path"), "date"):  # whole days
        write_partitions(probe_rows(read_reports(spark, [r.path for r in names])), table, "date")
    left = {r.date for r in here.select("date").distinct().collect()}
    for day in days:
        if day not in left:
            remove(spark, f"{table}/date={day}")
    if days:
        undated = kept.where("date is null").select("path", F.lit(number).cast("bigint").alias("build"))
        none = spark.createDataFrame([(None, number)], EXCLUDED)  # says that this build had no others
        undated.union(none).write.mode("append").parquet(f"{marker.rstrip('/')}-excluded")
        write_markers(spark, table, marker, here, days, left, undated)
    went = told.where("gone").select("path", "length", "modified", "date", F.lit(None).cast("string").alias("sha256"))
    seen.select("path", "length", "modified", "date", "sha256").union(went).withColumn("build", F.lit(number).cast("bigint")).write.mode("append").parquet(ledger)
    return len(days)


def write_markers(spark: SparkSession, table: str, marker: str, sources: DataFrame, days: Sequence, left: set, undated: DataFrame) -> None:
    """Append the marker of each rebuilt day: what is in its partition now, and for which sources it was written."""
    counted = spark.createDataFrame([], "date date, rows bigint, nulls map<string,bigint>")
    if left:
        rows = read_partitions(spark, table).where(F.col("date").isin(*left))
        others = [c for c in rows.columns if c != "date"]
        nulls = F.create_map(*(x for c in others for x in (F.lit(c), F.count_if(F.col(c).isNull()))))
        counted = rows.groupBy(F.col("date").cast("date").alias("date")).agg(F.count("*").alias("rows"), nulls.alias("nulls"))
    every = spark.createDataFrame([(d,) for d in days], "date date")
    others = undated.agg(F.count("*").alias("excluded"))
    out = every.join(sources_digest(sources), "date", "left").join(counted, "date", "left").join(F.broadcast(others))  # one row
    out = out.select("date", F.coalesce("sources", F.lit(0)).cast("bigint").alias("sources"), "sources_digest", F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), "nulls", "excluded", F.current_timestamp().alias("written"))
    out.coalesce(1).write.mode("append").parquet(marker)


def stream_probes(spark: SparkSession, reports: str, table: str, checkpoint: str, files: int | None = None):
    """Start a stream of new report files into probe rows, partitioned by day; it ends when all files are there.

    A file is read once, however often the stream is started with this checkpoint. Reports that are rewritten later make
    their day stale, and `build` writes it again.
    """
    source = spark.readStream.schema(REPORT).option("mode", "FAILFAST").option("multiLine", True)
    source = source.option("maxFilesPerTrigger", files) if files else source
    rows = probe_rows(source.json(reports).withColumn("path", F.col("_metadata.file_path")))
    return rows.writeStream.format("parquet").partitionBy("date").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def detection_rates(probes: DataFrame) -> DataFrame:
    """Probes and detections of each receiver."""
    return probes.groupBy("radio_id", "label").agg(F.count("*").alias("probes"), F.avg(F.coalesce("receiver_candidate", F.lit(False)).cast("int")).alias("rate"))


def write_listing(df: DataFrame, folder: str) -> None:
    """The listing as CSV with a header and as JSON lines."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    df.write.mode("overwrite").json(f"{folder}/jsonl")
