"""Reports, partitions, catalogues and logs on generated files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from orrery.sources import reports, text
from orrery.sources.catalog import query, register_tables


def report(probes: int = 2, **change) -> dict:
    rx = lambda s: {"acquisition": {"exact_match": {"frequency_offset_hz": 10.5, "epoch_sample": 7, "score": s}, "match_score_margin": 0.5}}
    check = {"start_s": 0.5, "candidate": True, "qualified": False, "cfo_difference_hz": 3.0, "receiver_candidates": [True, False], "receiver_qualified": [True, False], "receivers": [rx(9.0), rx(2.0)]}
    return {
        "capture_manifest": {"identity": {"radio_id": "r1", "serial": "s", "receiver_labels": ["lnb-a", "lnb-b"]}, "metadata": {"channel_number": 4, "region": "lower-edge", "observation_mode": "narrow"}, "created_utc_ns": 1_700_000_000_123_456_789, "gain_mode": "manual", "sample_statistics": {"receivers": [{"rms_magnitude": 100.0, "near_full_scale_fraction": 0.0}] * 2}},
        "exact_checks": [check] * probes, "lnb_calibration": {"applied": True, "reason": ""},
    } | change


def put(folder, name: str, doc: dict) -> None:
    (folder / f"{name}.json").write_text(json.dumps(doc))


def test_probe_rows_and_rates(spark, tmp_path):
    put(tmp_path, "ch4-lower-edge-narrow-20260811T120000Z", report(3))
    probes = reports.probe_rows(reports.read_reports(spark, str(tmp_path)))
    rows = probes.orderBy("probe", "receiver").collect()
    assert len(rows) == 6 and str(rows[0].date) == "2026-08-11" and rows[1].label == "lnb-b" and rows[1].score == 2.0
    assert rows[0].created_utc_ns == 1_700_000_000_123_456_789
    assert {r.label: r.rate for r in reports.detection_rates(probes).collect()} == {"lnb-a": 1.0, "lnb-b": 0.0}
    register_tables(spark, {"probes": probes})
    assert query(spark, "SELECT count(*) AS n FROM probes WHERE receiver_candidate").first().n == 3


@pytest.mark.parametrize("bad", [{"exact_checks": 5}, {"exact_checks": None}, {"capture_manifest": {"identity": {}}}])
def test_other_shapes_fail(spark, tmp_path, bad):
    put(tmp_path, "ch1-20260811T120000Z", report(**bad))
    with pytest.raises(Exception):  # noqa: B017
        reports.read_reports(spark, str(tmp_path)).collect()


def test_only_moved_days_are_rebuilt(spark, tmp_path):
    src, table, ledger = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "ledger")
    src.mkdir()
    put(src, "a-20260811T120000Z", report(1))
    put(src, "b-20260812T120000Z", report(2))
    assert reports.build(spark, str(src), table, ledger) == 2
    assert reports.build(spark, str(src), table, ledger) == 0
    put(src, "b-20260812T120000Z", report(5))
    assert reports.build(spark, str(src), table, ledger) == 1
    got = {str(r.date): r["count"] for r in reports.read_partitions(spark, table).groupBy("date").count().collect()}
    assert got == {"2026-08-11": 2, "2026-08-12": 10}


def checked(body: str) -> str:
    body = body.ljust(68)
    return body + str(sum(int(c) if c.isdigit() else c == "-" for c in body) % 10)


def test_element_sets_with_quarantine(spark):
    one, two = checked("1 25544U 98067A   24001.50000000  .00016717  00000-0  10270-3 0  900"), checked("2 25544  51.6400 208.9163 0006317  69.9862  25.2906 15.49815328 1234")
    alpha = checked("1 A0001U 98067A   24002.25000000  .00016717  00000-0  10270-3 0  900"), checked("2 A0001  51.6400 208.9163 0006317  69.9862  25.2906 15.49815328 1234")
    broken = one[:-1] + str((int(one[-1]) + 1) % 10)
    doc = "\n".join(["STATION", one, two, "ALPHA", *alpha, broken, two, one])
    rows = text.element_sets(spark.createDataFrame([("cat", doc)], "source string, value string")).collect()
    assert [(r.name, r.number, r.reason) for r in rows] == [("STATION", 25544, None), ("ALPHA", 100001, None), (None, 25544, "checksum"), (None, 25544, "no second line")]
    assert str(rows[0].epoch) == "2024-01-01 12:00:00"


def test_nmea_checksums(spark):
    def sentence(body: str) -> str:
        n = 0
        for c in body:
            n ^= ord(c)
        return f"${body}*{n:02X}"

    lines = [sentence("GPGGA,120000,4807.038,N,01131.000,E,1,08,0.9,545.4,M,46.9,M,,"), "$GPRMC,120000,A*00", "noise"]
    got = text.nmea(spark.createDataFrame([(x,) for x in lines], "value string")).select("kind", "valid", F.size("fields").alias("n")).collect()
    assert [(r.kind, r.valid) for r in got][:2] == [("GGA", True), ("RMC", False)] and got[0].n == 15 and not got[2].valid


def test_listing_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'q"x', 2.5)], "id int, name string, v double")
    reports.write_listing(df, str(tmp_path))
    csv = spark.read.schema("id int, name string, v double").option("header", True).csv(f"{tmp_path}/csv")
    assert sorted(csv.collect()) == sorted(df.collect())
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/jsonl").collect()) == [1, 2]


def test_build_reads_only_what_moved(spark, tmp_path, monkeypatch):
    import os

    src, table, ledger = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "ledger")
    src.mkdir()
    for i, day in enumerate((11, 12, 13)):
        put(src, f"r{i}-202608{day}T120000Z", report(i + 1))
    put(src, "no-stamp", report(1))
    read, digested = [], []
    monkeypatch.setattr(reports, "NAMES", 2)
    parse, digest = reports.read_reports, reports.digests
    monkeypatch.setattr(reports, "read_reports", lambda s, paths, *a: read.extend(paths) or parse(s, paths, *a))
    monkeypatch.setattr(reports, "digests", lambda s, paths: digested.extend(paths) or digest(s, paths))
    assert reports.build(spark, str(src), table, ledger) == 3 and len(read) == 3 and len(digested) == 4
    states = lambda: {str(r.date): r.state for r in reports.partition_status(spark, f"{ledger}-markers", ledger).where("date is not null").collect()}
    assert set(states().values()) == {"current"}
    marks = {str(r.date): r for r in reports.markers(spark, f"{ledger}-markers").collect()}
    assert marks["2026-08-13"].rows == 6 and marks["2026-08-13"].nulls["rms"] == 0 and marks["2026-08-13"].excluded == 1
    left_out = lambda: [os.path.basename(r.path) for r in reports.excluded(spark, f"{ledger}-markers").collect()]
    assert left_out() == ["no-stamp.json"]

    read.clear(), digested.clear()
    assert reports.build(spark, str(src), table, ledger) == 0 and not read and not digested
    os.utime(src / "r1-20260812T120000Z.json", (1, 1))  # touched only: read for its digest, not parsed
    assert reports.build(spark, str(src), table, ledger) == 0 and not read and len(digested) == 1
    digested.clear()
    (src / "r2-20260813T120000Z.json").unlink()
    put(src, "r1b-20260812T130000Z", report(4))
    assert reports.build(spark, str(src), table, ledger) == 2
    assert len(digested) == 1 and sorted(p.rsplit("/", 1)[1][:3] for p in read) == ["r1-", "r1b"]
    got = {str(r.date): r["count"] for r in reports.read_partitions(spark, table).groupBy("date").count().collect()}
    assert got == {"2026-08-11": 2, "2026-08-12": 12} and states() == {"2026-08-11": "current", "2026-08-12": "current", "2026-08-13": "gone"}
    assert reports.build(spark, str(src), table, ledger) == 0


def test_reports_stream_into_probe_rows(spark, tmp_path):
    src, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    src.mkdir()
    put(src, "a-20260811T120000Z", report(1))
    put(src, "b-20260812T120000Z", report(2))
    reports.stream_probes(spark, str(src), table, state, 1).awaitTermination()
    put(src, "c-20260812T130000Z", report(3))
    reports.stream_probes(spark, str(src), table, state).awaitTermination()
    got = {str(r.date): r["count"] for r in reports.read_partitions(spark, table).groupBy("date").count().collect()}
    assert got == {"2026-08-11": 2, "2026-08-12": 10}


def test_latest_fix(spark):
    def sentence(body: str, off: int = 0) -> str:
        total = off
        for c in body:
            total ^= ord(c)
        return f"${body}*{total:02X}"

    log = [
        ("a", 1, sentence("GPRMC,101112.25,A,4730.0000,N,01215.0000,W,,,280224,,,D")),
        ("a", 2, sentence("GPGGA,101112,4730.0000,N,01215.0000,W,1,09,0.8,431.5")),
        ("a", 3, sentence("GPRMC,101113,V,,,,,,,280224,,,N")),
        ("a", 4, sentence("GPRMC,101114,A,1000.0000,S,01215.0000,E,,,280224,,,A", off=1)),
        ("a", 5, sentence("GPGGA,101115,,,,,0,00,,")),
        ("a", 6, sentence("GPRMC,101116,A,1000.0000,S,01215.0000,E,,,310224,,,A")),
        ("b", 1, sentence("GNRMC,000000,A,1000.0000,S,01215.0000,E,,,010199,,,A")),
        ("c", 1, sentence("GPGGA,101112,4730.0000,N,01215.0000,W,1,09,0.8,431.5")),
        ("c", 2, None), ("c", 3, ""), ("c", 4, "$*00"),
    ]
    rows = text.latest_fix(spark.createDataFrame(log, "log string, at int, value string"), ["log"], "at").orderBy("log").collect()
    a, b = rows
    assert (str(a.gps), a.latitude, a.longitude, a["mode"], a.quality, a.satellites, a.hdop, a.altitude_m) == ("2024-02-28 10:11:12.250000", 47.5, -12.25, "D", 1, 9, 0.8, 431.5)
    assert (str(b.gps), b.latitude, b.longitude, b.quality) == ("1999-01-01 00:00:00", -10.0, 12.25, None)
