"""Registered queries against their SQL on the smallest data set."""

import glob
import os

import duckdb
import pytest

from lexgrid.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(small_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{small_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small_dir, duck, name):
    found = QUERIES[name](spark, small_dir)
    want = duck.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(want.select(*columns).fetchall())
