"""Queries against their SQL on rows where rounding, silence or the order of sums decide."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest

from orrery.plans import registry

registry.load()
START = datetime(2024, 1, 1)


@pytest.fixture
def both(spark, tmp_path):
    """(name, tables) to the rows of the query and of its SQL, sorted."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, (rows, schema, parts) in tables.items():
            path = f"{tmp_path}/{table}.parquet"
            spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(registry.ORACLE_SQL[name]).df()
        return sorted(map(tuple, got.collect())), sorted(tuple(r) for r in want[got.columns].itertuples(index=False))

    return run


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def test_a_silent_event_counts_as_the_lowest_level(both):
    rows = [(i, START + timedelta(seconds=i), i % 2, "view", v) for i, v in enumerate([0.0, 5.0, 10.0, 7.0, 20.0, 9.0, 40.0, 11.0], start=1)]
    got, want = both("a28_receiver_health", events=(rows, EVENTS, 1))
    assert got == want


def test_rounded_products_agree_with_sql_at_halves(both):
    rows = [(i, 1 + i % 6, cents / 100, d / 100) for i, (cents, d) in enumerate((c, d) for c in (*range(90_050, 90_100), 109_421) for d in (1, 3, 5, 7, 9, 10))]
    got, want = both("u03_parity_both_ways", lineitem=(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double", 1))
    assert got == want


def test_sums_that_end_in_a_half_are_the_same_in_any_order(spark, tmp_path):
    rows = [(c, round(0.05 + 0.1 * (c % 7), 2)) for c in range(97, 197) for _ in range(3)]
    rows += [(c, x) for c in range(97, 197) for x in (1e9 + 0.1, 0.3, 0.7, 12.15)]
    seen = set()
    for i, parts in enumerate((1, 3, 7)):
        spark.createDataFrame(rows[i:] + rows[:i], "o_custkey long, o_totalprice double").repartition(parts).write.parquet(f"{tmp_path}/{i}/orders.parquet")
        seen.add(tuple(sorted(map(tuple, registry.QUERIES["c09_projection_parity"](spark, f"{tmp_path}/{i}").collect()))))
    assert seen == {(("left", 2), ("right", 2))}  # 97 and 194


def test_tracks_of_equal_values_in_any_order_tie_by_key(spark, tmp_path):
    from orrery.plans.join_queries import tracks

    values = [0.1, 0.2, 0.3, 0.7, 1.1, 1e6 + 0.1, 12.15]
    rows = [(u * 10 + i, START + timedelta(minutes=i), u, "error", v) for u in range(2, 9) for i, v in enumerate(values[u % 7 :] + values[: u % 7])]
    rows += [(i, START + timedelta(minutes=i), 1, "view", 1.0) for i in range(7)]
    spark.createDataFrame(rows, EVENTS).repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    means = tracks(registry.Tables(spark, str(tmp_path))).where("event_type = 'error'").select("m").distinct().count()
    assert means == 1
    assert [r.cand for r in registry.QUERIES["j25_event_hypotheses"](spark, str(tmp_path)).collect()] == [2]


@pytest.mark.parametrize("name", ["j22_track_pairs", "j25_event_hypotheses", "j26_rate_match"])
def test_means_add_up_in_the_order_of_rows_as_in_sql(spark, tmp_path, name):
    """The last bit of a mean decides a gate of 20 and which of two candidates is nearest; the file is in order, the reader is not."""
    rows = []
    for kind, user, values in (
        ("signup", 2, [26.92, 31.17, 30.62]), ("signup", 1, [49.57, 49.57]), ("view", 1, [1.48, 1.48]),
        ("error", 3, [6.45, 3.13, 4.64]), ("error", 2, [4.74, 4.74]), ("click", 3, [6.45, 3.13, 4.64]), ("click", 2, [4.74, 4.74]),
    ):
        rows += [(len(rows) + i, START + timedelta(minutes=10 * i), user, kind, v) for i, v in enumerate(values)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", rows)
    want = con.execute(registry.ORACLE_SQL[name]).df()
    spark.createDataFrame(rows[::-1], EVENTS).repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in want[got.columns].itertuples(index=False))
