"""Census, authentication and sweep import on files."""

from __future__ import annotations

import hashlib
import json

from orrery.sources import files


def test_census_counts_all_and_reads_to_the_limit(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)

    for i in range(5):
        put(f"{i}.json", json.dumps({"schema": "v2", "n": i}, indent=1))
    for i in range(3):
        put(f"old{i}.json", json.dumps({"schema": "v1", "n": i}))
    put("none.json", '{"n": 1}')
    put("torn.json", '{"schema": "v2", "n": ')
    put("list.json", "[1, 2]")
    put("empty.json", "")  # no bytes: Spark does not list it
    documents, counted = files.census(spark, str(tmp_path), "v2", "n int", limit=2)
    assert [r.document.n for r in documents.orderBy("path").collect()] == [0, 1]
    got = {(r.status, r.tag): r.documents for r in counted.collect()}
    assert got == {("read", "v2"): 2, ("beyond_limit", "v2"): 3, ("other_schema", "v1"): 3, ("other_schema", files.UNDECLARED): 1, ("unreadable", None): 2}
    documents, counted = files.census(spark, str(tmp_path), "v2", "n int")
    assert documents.count() == 5 and {r.documents for r in counted.where("status = 'read'").collect()} == {5}
    documents, counted = files.census(spark, str(tmp_path), "v9", "n int", limit=3)
    assert documents.count() == 0 and counted.where("status IN ('read', 'beyond_limit')").count() == 0


def test_claims_against_files(spark, tmp_path):
    root = tmp_path / "store"
    claims = []
    for run in ("good", "longer", "swapped", "gone", "outside", "short"):
        (root / run).mkdir(parents=True)
        for kind in ("analysis", "log"):
            text = f"{run} {kind}".encode()
            name = f"{run}/{kind}.json"
            claims.append((run, kind, name, len(text), hashlib.sha256(text).hexdigest()))
            (root / name).write_bytes(text + b"!" if (run, kind) == ("longer", "log") else text[::-1] if (run, kind) == ("swapped", "log") else text)
    (root / "gone" / "log.json").unlink()
    claims = [c for c in claims if c[:2] != ("short", "log")]
    claims.append(("outside", "key", "../secret", 1, "x"))
    df = spark.createDataFrame(claims, "run string, kind string, name string, bytes long, sha256 string")
    told, runs = files.authenticated(df, files.contents(spark, str(root), "store"), ["analysis", "log"])
    assert {r.run: (r.accepted, r.reasons) for r in runs.collect()} == {
        "good": (True, []), "longer": (False, ["length log"]), "swapped": (False, ["changed log"]), "gone": (False, ["missing log"]), "outside": (False, ["unsafe key"]), "short": (False, ["unclaimed log"]),
    }
    assert told.count() == len(claims) and told.where("refused IS NULL").count() == len(claims) - 4


def test_sweeps_give_an_entry_for_each_usable_radio(spark, tmp_path):
    fine = lambda *t, **change: {"error": None, "tunings": [list(x) for x in t], "skew_s": [0.1 * i for i in range(len(t))], "iq": {"shape": [len(t), 2, 64]}} | change
    order = ((4, "lower"), (2, "upper"), (4, "upper"))
    records = [
        {"sweep": "s1", "radios": {"a": fine(*order), "b": fine(*order[::-1], skew_s=[0.5])}}, {"sweep": "s2", "radios": {"a": fine(*order), "b": fine(*order, error="timeout")}},
        {"sweep": "s3", "radios": {"a": fine(), "b": fine((1, "side")), "c": fine(("x", "lower"))}}, {"sweep": "s4", "radios": {"a": fine(*order, iq={"shape": [8]}), "b": None, "c": fine(*order, tunings=None)}},
        {"sweep": "s5", "radios": {}}, {"sweep": "s6", "radios": None},
    ]
    (tmp_path / "sweeps.json").write_text("\n".join(map(json.dumps, records)))
    entries, reasons = files.sweeps(files.read_sweeps(spark, str(tmp_path)), {"lower": "lower-edge", "upper": "upper-edge"})
    got = {(r.sweep, r.radio): r for r in entries.collect()}
    assert set(got) == {("s1", "a"), ("s1", "b"), ("s2", "a")}
    assert [(t.channel, t.region, t.skew_s) for t in got["s1", "b"].order] == [(4, "upper-edge", 0.5), (2, "upper-edge", None), (4, "lower-edge", None)]
    assert got["s1", "a"].peers == ["b"] and got["s2", "a"].peers == []
    assert {r.reason: r.radios for r in reasons.collect()} == {"radio failed": 2, "no tunings": 2, "unknown edge": 1, "tuning is not (channel, edge)": 1, "samples of another number of tunings": 1}


def test_many_small_files_are_written_by_several_tasks(spark, tmp_path):
    from orrery.plans import file_queries

    rows = spark.range(40).selectExpr("id AS k", "CAST(id AS STRING) AS value").coalesce(1)
    file_queries.stored(rows, ["k"], str(tmp_path / "f"))
    found = [*(tmp_path / "f").rglob("part-*.txt")]
    assert len(found) == 40 and len({x.name.split("-")[1] for x in found}) >= 8
