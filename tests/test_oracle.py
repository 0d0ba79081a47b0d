"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from orrery.plans import registry

registry.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or "datetime" in str(df[c].dtype):
            df[c] = df[c].map(lambda v: "" if v is None or v is pd.NaT or v != v else str(v))
        else:
            df[c] = df[c].astype(float).round(6)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def test_names_match():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 180


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got.columns) > 0
        return
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = plain(got), plain(want)
    for c in a.columns:
        if a[c].dtype == object or b[c].dtype == object:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
        else:
            assert np.allclose(a[c], b[c], rtol=1e-9, atol=1e-6, equal_nan=True), c
