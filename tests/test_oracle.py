"""Every query against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest

from millrace.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and np.isnan(value)):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(int(value))
    if isinstance(value, (float, np.floating)):
        return f"{value:.6f}"
    if isinstance(value, (int, np.integer)):
        return f"{float(value):.6f}" if abs(value) < 1 << 50 else str(value)
    return str(value)


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(plain(v) for v in row) for row in df[cols].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    # bool columns come as 0/1 from one side and as 0.000000/1.000000 from the other at most
    norm = lambda r: tuple({"0": "0.000000", "1": "1.000000"}.get(v, v) for v in r)
    assert sorted(map(norm, a)) == sorted(map(norm, b))
