"""Every engine query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from trackfold.plans.catalog import QUERIES, SQL

PLACE = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, np.ndarray | list | tuple):
        return [plain(x) for x in v]
    if v is None or (isinstance(v, float | np.floating) and v != v):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return int(v)
    return float(v) if isinstance(v, float | np.floating) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(PLACE):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{PLACE}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, PLACE)
    got = [dict(zip(df.columns, map(plain, r), strict=True)) for r in df.collect()]
    want = duck.sql(SQL[name]).df().astype(object).to_dict("records")
    text = lambda rows: sorted(repr([plain(r[c]) for c in sorted(r)]) for r in rows)
    assert sorted(df.columns) == sorted(want[0]) and text(got) == text(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, PLACE).count() > 0
