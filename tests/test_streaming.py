"""The streaming operators on file streams that are run until they have nothing left."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orrery.streaming import spectra, windows

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, k string, ts timestamp, v double"


def stream(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "b*"))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).toPandas()


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def test_windows_equal_the_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], at(7 * i), float(i)) for i in range(60)]
    late = [(99, "a", at(5000), 0.0)]
    got = run(windows.tumbling_review(stream(spark, tmp_path, [rows[:30], rows[30:], late]), "ts", ["k"], "v", "1 hour"), "tumbling")
    want = windows.tumbling_review(spark.createDataFrame(rows, SCHEMA), "ts", ["k"], "v", "1 hour").toPandas()
    key = ["opens", "k"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))


def test_sessions_join_at_the_gap(spark):
    rows = [(1, "a", at(0), 0.0), (2, "a", at(10), 0.0), (3, "a", at(20.5), 0.0)]
    got = windows.sessions(spark.createDataFrame(rows, SCHEMA), "ts", ["k"], "10 minutes").orderBy("opens").collect()
    assert [r.n for r in got] == [2, 1]


def test_redelivery_is_dropped(spark, tmp_path):
    rows = [(i, "a", at(i), 0.0) for i in range(5)]
    assert len(run(windows.deduplicated(stream(spark, tmp_path, [rows, rows[2:]]), "ts", ["id"], "1 hour"), "dedup")) == 5


def test_confirmations_across_batches(spark, tmp_path):
    rows = [[(1, "a", at(0), 10.0), (2, "b", at(0), 5.0)], [(3, "a", at(1), 12.0)], [(4, "a", at(1.5), 40.0), (5, "b", at(30), 5.0)]]
    events = stream(spark, tmp_path, rows).withColumn("s", F.unix_seconds("ts").cast("double"))
    got = run(windows.confirmations(events, "k", "s", "v", 120, 5), "confirmed")
    assert [(r.key, r.value, r.previous_value) for r in got.itertuples()] == [("a", 12.0, 10.0)]


def test_promotion_happens_once(spark, tmp_path):
    batches = [[(i, "a", at(i), 1.0) for i in range(4)], [(9, "a", at(9), 5.0)], [(10, "a", at(10), 6.0)]]
    events = stream(spark, tmp_path, batches).withColumn("s", F.unix_seconds("ts").cast("double"))
    got = run(windows.promotions(events, "k", "s", "v", 4, 3.0), "promoted")
    assert [(r.score, r.reference) for r in got.itertuples()] == [(5.0, 1.0)]


def test_upsert_keeps_the_newest_of_touched_days(spark):
    held = {}
    sink = windows.upsert_days(lambda df: held.update(rows=spark.createDataFrame(df.collect(), df.schema)), lambda: held.get("rows"), "id", "day", "seen")
    rows = lambda *x: spark.createDataFrame(list(x), "id long, day string, seen long")
    sink(rows((1, "d1", 1), (2, "d1", 1)), 0)
    sink(rows((1, "d1", 2)), 1)
    assert sorted((r.id, r.seen) for r in held["rows"].collect()) == [(1, 2), (2, 1)]


def test_a_moved_key_leaves_its_old_day(spark, tmp_path):
    from orrery.sources import scratch

    table, schema = str(tmp_path / "t"), "id long, v string, seen long, day string"
    read = lambda: spark.read.schema(schema).parquet(table) if scratch.exists(spark, table) else None
    write = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)
    new = lambda: windows.upsert_days(write, read, "id", "day", "seen", lambda days: [scratch.remove(spark, f"{table}/day={d}") for d in days])
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    held = lambda: sorted((r.id, r.day, r.seen) for r in read().collect())
    new()(rows((1, "a", 1, "d1"), (2, "a", 1, "d2"), (3, "a", 1, "d2")), 0)
    moved = rows((1, "b", 2, "d2"), (3, "b", 0, "d9"))
    new()(moved, 1)  # a sink of its own, as after a restart; an older row of another day changes nothing
    want = [(1, "d2", 2), (2, "d2", 1), (3, "d2", 1)]
    assert held() == want and sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("day")) == ["day=d2"]
    new()(moved, 1)  # delivered again
    assert held() == want


def test_two_evidences_promote_once(spark, tmp_path):
    schema = "id long, key string, kind string, at double, score double"
    batches = [
        [(1, "x", "a", 10.0, 5.0), (2, "y", "b", 10.0, 5.0), (3, "z", "a", 10.0, 5.0), (4, "w", "a", 1.0, 5.0)],
        [(5, "x", "b", 14.0, 5.0), (6, "y", "a", 7.0, 5.0), (7, "z", "b", 40.0, 5.0), (8, "w", "b", 2.0, 0.5)],
        [(9, "x", "a", 15.0, 9.0), (10, "x", "b", 15.0, 9.0), (11, "z", "a", 41.0, None), (12, "z", "a", 38.0, 6.0), (13, "v", "c", 1.0, 9.0)],
    ]
    for order, name in (((0, 1, 2), "p"), ((2, 1, 0), "q")):
        root = tmp_path / name
        for n, i in enumerate(order):  # each batch comes after a restart
            spark.createDataFrame(batches[i], schema).coalesce(1).write.mode("append").parquet(str(root / "in"))
            source = spark.readStream.schema(schema).parquet(str(root / "in"))
            q = windows.two_evidences(source, "key", "kind", "at", "score", 5.0, (1.0, 1.0)).writeStream.format("parquet").option("path", str(root / "out")).option("checkpointLocation", str(root / "state")).trigger(availableNow=True).start()
            assert q.awaitTermination(120) and q.exception() is None, n
        got = sorted((r.key, r.at) for r in spark.read.schema(windows.PROMOTED).parquet(str(root / "out")).collect())
        assert [k for k, _ in got] == ["x", "y", "z"]
        if name == "p":
            assert got == [("x", 14.0), ("y", 10.0), ("z", 40.0)]

def test_snapshots_are_published_once(spark, tmp_path):
    from orrery.streaming import catalogue

    day = dt.datetime(2024, 5, 1)
    rows = lambda source, n, when=day, epoch=day: [(source, "all", when, i, epoch, f"1 {i}", f"2 {i}") for i in range(n)]
    schema = "source string, scope string, retrieved timestamp_ntz, number long, epoch timestamp_ntz, line1 string, line2 string"
    frame = lambda x: spark.createDataFrame(x, schema)
    root = str(tmp_path / "cat")
    sink = catalogue.publisher(root, 3, 10, 86_400.0)
    first = rows("a", 5) + rows("b", 2) + rows("c", 12) + [*rows("d", 4), ("d", "all", day, 1, day, "other", "x")] + rows("e", 4, epoch=day - dt.timedelta(days=3)) + [*rows("f", 4), ("f", "all", day, 9, None, "x", "y")]
    sink(frame(first), 0)
    sink(frame(list(reversed(first))), 0)  # the same batch, in another order
    later = day + dt.timedelta(hours=2)
    catalogue.publisher(root, 3, 10, 86_400.0)(frame(rows("a", 5, later)), 1)  # the same content, retrieved again
    entries = spark.read.schema(catalogue.ENTRY).parquet(f"{root}/entries").collect()
    assert {(r.source, r.retrieved, r.refused) for r in entries} == {("a", day, None), ("a", later, None), ("b", day, "too few"), ("c", day, "too many"), ("d", day, "repeated numbers"), ("e", day, "stale"), ("f", day, "incomplete")}
    assert len(entries) == 7 and len({r.digest for r in entries if r.source == "a"}) == 1
    assert spark.read.parquet(f"{root}/content").count() == 5


def test_catalogue_has_no_folder_for_each_content(spark, tmp_path):
    from orrery.streaming import catalogue

    day = dt.datetime(2024, 5, 1)
    schema = "source string, scope string, retrieved timestamp_ntz, number long, epoch timestamp_ntz, line1 string, line2 string"
    frame = spark.createDataFrame([(f"s{k}", "all", day, i, day, f"1 {k}", f"2 {i}") for k in range(600) for i in range(3)], schema)
    root = str(tmp_path / "cat")
    catalogue.publisher(root, 3, 10, 86_400.0)(frame, 0)
    content = spark.read.parquet(f"{root}/content")
    assert content.count() == 1800 and content.select("digest").distinct().count() == 600
    assert len([*(tmp_path / "cat" / "content").rglob("*.parquet")]) <= 256
    # The sink died after the content: the batch comes again, and each content is still there once.
    (tmp_path / "cat" / "entries").rename(tmp_path / "gone")
    catalogue.publisher(root, 3, 10, 86_400.0)(frame, 0)
    assert spark.read.parquet(f"{root}/content").count() == 1800 and spark.read.parquet(f"{root}/entries").count() == 600


def test_paired_instants(spark):
    a = spark.createDataFrame([(1, "a", at(0), 0.0), (2, "a", at(100), 0.0)], SCHEMA).select(F.col("id").alias("x"), "k", F.col("ts").alias("t"))
    b = spark.createDataFrame([(7, "a", at(2), 0.0)], SCHEMA).select(F.col("id").alias("y"), "k", F.col("ts").alias("u"))
    assert [(r.x, r.y) for r in windows.paired_instants(a, b, ["k"], "t", "u", "5 minutes").collect()] == [(1, 7)]


def spectra_stream(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "b*"))


def test_novel_blocks_keep_the_strongest(spark, tmp_path):
    noise = np.random.default_rng(3).normal(0, 0.02, (40, 2, 128))
    # Both receivers rise at 20, 22 (near 20, stronger) and 35; at 30 one receiver alone does; 2 lies in the warm-up.
    for block, height, receivers in ((2, 9, (0, 1)), (20, 3, (0, 1)), (22, 5, (0, 1)), (30, 9, (0,)), (35, 4, (0, 1))):
        for r in receivers:
            noise[block, r, 60 + 3 * r : 63 + 3 * r] += height
    rows = [("k", i, x[0].tolist(), x[1].tolist()) for i, x in enumerate(noise)]
    schema = "key string, block long, a array<double>, b array<double>"
    df = spectra.novel_blocks(spectra_stream(spark, tmp_path, [rows[:10], rows[10:25], rows[25:]], schema), "key", "block", ("a", "b"), most=2)
    got = run(df, "novel", "update").tail(2).sort_values("block")
    assert got.block.tolist() == [22, 35] and (got.score > 1).all()
    assert got.bin_0.between(60, 62).all() and got.bin_1.between(63, 65).all()


def test_motion_needs_both_receivers(spark, tmp_path):
    base = np.random.default_rng(5).normal(0, 1, 96)
    frame = lambda key, cycle, receiver, shift: (key, cycle, receiver, np.roll(base, shift).tolist())
    first = [frame("a", 1, 0, 0), frame("a", 1, 1, 0), frame("b", 1, 0, 0), frame("b", 1, 1, 0), frame("c", 1, 0, 0)]
    second = [frame("a", 2, 0, 5), frame("b", 2, 0, 5), frame("b", 2, 1, -5), frame("c", 2, 0, 5)]
    third = [frame("a", 2, 1, 6), frame("a", 2, 1, 6), frame("a", 4, 0, 9), frame("a", 4, 1, 9), frame("a", 2, 0, 1)]
    schema = "key string, cycle long, receiver int, level array<double>"
    df = spectra.motions(spectra_stream(spark, tmp_path, [first, second, third], schema), "key", "cycle", "receiver", "level", 1.0, least=2, most=20, tolerance=2)
    got = run(df, "motion")
    assert [(r.key, r.previous, r.cycle, r.shift, r.shift_0, r.shift_1) for r in got.itertuples()] == [("a", 1, 2, 5.5, 5.0, 6.0)]
