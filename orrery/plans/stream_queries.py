"""ST: streaming operators over the events table; the tests run them on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.registry import Tables, query
from orrery.sources import reports, scratch
from orrery.streaming import spectra, windows


@query("st04_trailing_activity", """
SELECT strftime(o, '%Y-%m-%d %H:%M') AS opens, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts) - i * INTERVAL 1 HOUR AS o FROM events, (SELECT unnest(range(0, 6)) AS i)) GROUP BY ALL""")
def st04(t: Tables) -> DataFrame:
    g = windows.trailing_activity(t.events, "ts", ["event_type"], "value", "6 hours", "1 hour")
    return g.select(F.date_format("opens", "yyyy-MM-dd HH:mm").alias("opens"), "event_type", "n", F.round("total", 4).alias("total"))


@query("st05_tumbling_review", """
SELECT strftime(time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS opens, event_type, count(*) AS n, max(value) AS peak FROM events GROUP BY ALL""")
def st05(t: Tables) -> DataFrame:
    g = windows.tumbling_review(t.events, "ts", ["event_type"], "value", "4 hours")
    return g.select(F.date_format("opens", "yyyy-MM-dd HH:mm").alias("opens"), "event_type", "n", "peak")


@query("st06_event_sessions", """
WITH j AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS o FROM events), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM j)
SELECT user_id, epoch_us(min(ts)) AS opens, count(*) AS n FROM g GROUP BY user_id, s""")
def st06(t: Tables) -> DataFrame:
    from orrery.functions.scalars import micros

    g = windows.sessions(t.events, "ts", ["user_id"], "2 hours")
    return g.select("user_id", micros(F.col("opens").cast("timestamp_ntz")).alias("opens"), "n")


@query("st11_stale_producers", """
SELECT user_id, round(epoch_us(TIMESTAMP '2024-01-31') / 1e6 - epoch_us(max(ts)) / 1e6, 3) AS age_s, epoch_us(TIMESTAMP '2024-01-31') / 1e6 - epoch_us(max(ts)) / 1e6 > 43200 AS stale FROM events GROUP BY 1""")
def st11(t: Tables) -> DataFrame:
    s = windows.stale_producers(t.events, "user_id", "ts", "timestamp_ntz '2024-01-31 00:00:00'", 43_200)
    return s.select("user_id", F.round("age_s", 3).alias("age_s"), "stale")


@query("st13_stream_static_enrichment", """
WITH i AS (SELECT event_id, user_id AS k, ts - INTERVAL 10000 DAY AS at_ FROM events), o AS (SELECT o_custkey AS k, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) SELECT event_id, o_orderkey FROM i ASOF LEFT JOIN o ON i.k = o.k AND at_ >= o_orderdate""")
def st13(t: Tables) -> DataFrame:
    i = t.events.select("event_id", F.col("user_id").alias("k"), (F.col("ts") - F.expr("interval 10000 days")).alias("at_"))
    o = t.orders.groupBy(F.col("o_custkey").alias("k"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return windows.enriched(i, o, ["k"], "at_", "o_orderdate", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("st14_paired_instants", """
SELECT x.event_id AS a, y.event_id AS b FROM events x JOIN events y ON x.event_type = 'view' AND y.event_type = 'click' AND x.user_id = y.user_id AND y.ts BETWEEN x.ts - INTERVAL 30 MINUTE AND x.ts + INTERVAL 30 MINUTE""")
def st14(t: Tables) -> DataFrame:
    side = lambda kind, i, at: t.events.where(f"event_type = '{kind}'").select("user_id", F.col("event_id").alias(i), F.col("ts").alias(at))
    return windows.paired_instants(side("view", "a", "at"), side("click", "b", "bt"), ["user_id"], "at", "bt", "30 minutes").select("a", "b")


def drained(t: Tables, stream: DataFrame) -> DataFrame:
    """What the stream puts out until its files are used up, by way of the shared folder."""
    root = scratch.fresh(t.spark, "stream")
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{root}/out")


def arriving(t: Tables, rows: DataFrame, files: int = 4) -> DataFrame:
    """The rows as a stream of files, one at a time."""
    root = scratch.fresh(t.spark, "arriving")
    rows.repartition(files, *rows.columns[:1]).write.parquet(root)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(root)


@query("st01_report_stream", """
SELECT recording, probe, receiver, start_s, offset_hz, count(*) AS n FROM (SELECT 'ch' || (o_custkey % 8 + 1) || '-' || strftime(o_orderdate, '%Y%m%d') || 'T120000Z' AS recording, CAST(row_number() OVER (PARTITION BY o_orderkey, r ORDER BY l_linenumber, l_quantity, l_extendedprice) - 1 AS INTEGER) AS probe, CAST(r AS INTEGER) AS receiver, l_quantity AS start_s, l_extendedprice * (1 + r) AS offset_hz
FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') JOIN lineitem ON l_orderkey = o_orderkey, (SELECT unnest([0, 1]) AS r)) GROUP BY ALL""")
def st01(t: Tables) -> DataFrame:
    """Reports arrive as files, one report a line; the stream reads them under the contract and puts out probe rows by day."""
    root = scratch.fresh(t.spark, "reports")
    match = lambda times: F.struct(F.struct(F.struct((F.col("l_extendedprice") * times).alias("frequency_offset_hz"), F.lit(0).cast("bigint").alias("epoch_sample"), F.col("l_discount").alias("score")).alias("exact_match"), F.col("l_tax").alias("match_score_margin")).alias("acquisition"))
    check = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("start_s"), F.lit(True).alias("candidate"), F.lit(False).alias("qualified"), F.array(match(1), match(2)).alias("receivers"))
    nested = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(check)).alias("exact_checks"))
    name = F.concat(F.lit("ch"), (F.col("o_custkey") % 8 + 1).cast("string"), F.lit("-"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T120000Z"))
    manifest = F.struct(F.struct(F.col("o_custkey").cast("string").alias("radio_id"), F.array(F.lit("lnb-a"), F.lit("lnb-b")).alias("receiver_labels")).alias("identity"), F.col("o_orderkey").cast("bigint").alias("created_utc_ns"))
    docs = t.orders.where("o_orderstatus = 'F'").join(nested, "o_orderkey").select(name.alias("recording"), manifest.alias("capture_manifest"), "exact_checks")
    docs.write.json(root)
    source = t.spark.readStream.schema(f"recording string, {reports.REPORT}").option("mode", "FAILFAST").option("maxFilesPerTrigger", 4).json(root)
    # probe_rows takes a recording's name from its path, and a check's place from its array.
    probes = reports.probe_rows(source.withColumn("path", F.concat(F.lit("/"), "recording", F.lit(".json"))))
    out = drained(t, probes)
    return out.groupBy("recording", "probe", "receiver", "start_s", "offset_hz").agg(F.count("*").alias("n"))


@query("st02_newest_delivery", """
SELECT user_id, d AS day, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS d FROM events) GROUP BY ALL""")
def st02(t: Tables) -> DataFrame:
    """A recording that is published again replaces what was there: each batch rewrites the days that it touches."""
    root = scratch.fresh(t.spark, "newest")
    rows = t.events.select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("key"), "event_id", "value")
    stream = arriving(t, rows)
    schema = rows.schema

    def read() -> DataFrame | None:
        return t.spark.read.schema(schema).parquet(f"{root}/table") if scratch.exists(t.spark, f"{root}/table") else None

    def write(df: DataFrame) -> None:
        kept = scratch.written(df, "days")  # the days are read and replaced in one job
        kept.select(*schema.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/table")

    sink = windows.upsert_days(write, read, "key", "day", "event_id")
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(schema).parquet(f"{root}/table").select("user_id", "day", "event_id", "value")


@query("st02_moved_keys", """
SELECT user_id, strftime(arg_max(ts, event_id), '%Y-%m-%d') AS day, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1""")
def st02_moved(t: Tables) -> DataFrame:
    """Each user's newest event, in the folder of its day: a newer one of another day leaves none behind."""
    root = scratch.fresh(t.spark, "moved")
    rows = t.events.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    table = f"{root}/table"

    def read() -> DataFrame | None:
        return t.spark.read.schema(rows.schema).parquet(table) if scratch.exists(t.spark, table) else None

    def write(df: DataFrame) -> None:
        df.select(*rows.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)

    sink = windows.upsert_days(write, read, "user_id", "day", "event_id", lambda days: [scratch.remove(t.spark, f"{table}/day={d}") for d in days])
    arriving(t, rows).writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(table).select("user_id", "day", "event_id", "value")


@query("st03_late_days", """
WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, value FROM events), first AS (SELECT * FROM e WHERE event_id % 4 <> 0), late AS (SELECT DISTINCT day FROM e WHERE event_id % 4 = 0)
SELECT day, count(*) AS rows, round(sum(value), 4) AS total, day IN (SELECT day FROM late) AS rebuilt FROM e GROUP BY day""")
def st03(t: Tables) -> DataFrame:
    """A day that gains rows after it was written is written again from all its rows; other days stay as they are."""
    root = scratch.fresh(t.spark, "late")
    e = t.events.select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    days = lambda df: df.groupBy("day").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))
    put = lambda df, mark: days(df).withColumn("rebuilt", F.lit(mark)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{root}/table")
    put(e.where("event_id % 4 <> 0"), False)

    def rebuild(batch: DataFrame, _: int) -> None:
        put(e.join(batch.select("day").distinct(), "day", "left_semi"), True)

    arriving(t, e.where("event_id % 4 = 0")).writeStream.foreachBatch(rebuild).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    out = t.spark.read.schema("rows bigint, total double, rebuilt boolean, day string").parquet(f"{root}/table")
    return out.select("day", "rows", F.round("total", 4).alias("total"), "rebuilt")


def levels(t: Tables, key: str, at: str, receiver: str, bins: int) -> DataFrame:
    """Spectra of the events' values: of each key, time and receiver the decibels of each bin of `value` from 0 to 500."""
    e = t.events.selectExpr(f"{key} AS key", f"{at} AS at", f"{receiver} AS receiver", f"least({bins - 1}, greatest(0, cast(floor(value * {bins} / 500) AS int))) AS bin").groupBy("key", "at", "receiver", "bin").count()
    held = F.map_from_entries(F.collect_list(F.struct("bin", "count")))  # at most `bins` entries
    g = e.groupBy("key", "at", "receiver").agg(held.alias("held"))
    level = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: 10 * F.log10(1.0 + F.coalesce(F.try_element_at("held", b), F.lit(0))))
    return g.select("key", "at", "receiver", level.alias("level"))


HOUR = "cast(floor(unix_timestamp(cast(ts AS timestamp)) / 3600) AS bigint)"


@query("st08_novel_blocks")
def st08(t: Tables) -> DataFrame:
    """The most novel hours of each kind of event, held against its first sixteen; no SQL: the tests plant them."""
    rows = levels(t, "event_type", HOUR, "cast(user_id % 2 AS int)", 32)
    side = lambda r: F.max(F.when(F.col("receiver") == r, F.col("level")))
    pairs = rows.groupBy("key", "at").agg(side(0).alias("a"), side(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    found = spectra.novel_blocks(arriving(t, pairs), "key", "at", ("a", "b"))
    root = scratch.fresh(t.spark, "novel")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{root}/out")

    found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    out = t.spark.read.schema(f"{spectra.SELECTED}, batch int").parquet(f"{root}/out")
    newest = out.groupBy("key").agg(F.max("batch").alias("batch"))
    return out.join(newest, ["key", "batch"]).drop("batch")


@query("st10_cycle_motion")
def st10(t: Tables) -> DataFrame:
    """Displacements of each kind's spectrum from one day to the next that both receivers show; no SQL: the tests plant them."""
    rows = levels(t, "event_type", f"cast(floor({HOUR} / 24) AS bigint)", "cast(user_id % 2 AS int)", 64)
    return drained(t, spectra.motions(arriving(t, rows), "key", "at", "receiver", "level", 1.0, least=1.0, most=16.0, correlation=0.3, tolerance=2.0, lag=1))


@query("st09_two_evidences", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) / 1e6 AS at_s, value, event_type FROM events), a AS (SELECT * FROM e WHERE event_type = 'view' AND value >= 60), b AS (SELECT * FROM e WHERE event_type = 'click' AND value >= 40),
p AS (SELECT a.key, greatest(a.at_s, b.at_s) AS at_s FROM a JOIN b ON a.key = b.key AND abs(a.at_s - b.at_s) <= 21600) SELECT key, count(*) AS promotions FROM (SELECT DISTINCT key FROM p) GROUP BY 1""")
def st09(t: Tables) -> DataFrame:
    """Users whose views and clicks support each other: each is promoted once, in whichever batch that shows; a stopped stream goes on from its state."""
    kind = F.when(F.col("event_type") == "view", "a").when(F.col("event_type") == "click", "b")
    rows = t.events.select("event_id", F.col("user_id").alias("key"), kind.alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("value").alias("score")).where("kind is not null")
    out = drained(t, windows.two_evidences(arriving(t, rows, 3), "key", "kind", "at", "score", 21_600.0, (60.0, 40.0), hold=float("inf")))
    return out.groupBy("key").agg(F.count("*").alias("promotions"))


@query("st12_snapshot_stream", """
SELECT CAST(o_custkey AS VARCHAR) AS source, count(*) AS sets, CASE WHEN count(*) < 5 THEN 'too few' WHEN count(*) > 15 THEN 'too many' WHEN count(DISTINCT o_orderkey // 2) < count(*) THEN 'repeated numbers' WHEN max(o_orderdate) < TIMESTAMP '1998-01-01' THEN 'stale' END AS refused FROM orders GROUP BY 1""")
def st12(t: Tables) -> DataFrame:
    """Each customer's orders as one snapshot of element sets, every snapshot delivered twice."""
    from orrery.streaming import catalogue

    root = scratch.fresh(t.spark, "catalogue")
    sets = t.orders.select(
        F.col("o_custkey").cast("string").alias("source"), F.lit("all").alias("scope"), F.expr("timestamp_ntz '1998-01-02 00:00:00'").alias("retrieved"), F.expr("o_orderkey div 2").alias("number"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("epoch"), F.col("o_orderkey").cast("string").alias("line1"), F.col("o_orderpriority").alias("line2"),
    )
    for copy in ("one", "two"):
        sets.repartition(2, "source").write.parquet(f"{root}/in/{copy}")
    stream = t.spark.readStream.schema(sets.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
    sink = catalogue.publisher(root, 5, 15, 86_400.0)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(catalogue.ENTRY).parquet(f"{root}/entries").select("source", "sets", "refused")
