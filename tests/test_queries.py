"""Every query of the library proper against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from parchment import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(frame):
    """The rows in order, columns by name; numbers as floats, as a null makes floats of a column of integers."""
    return sorted(repr([plain(x) for x in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    return round(float(x), 6) if type(x).__name__ in ("int", "float", "Decimal") else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF_DIR).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
