import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from parchment.llm import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n[:2] == "op" and n[2].isdigit()}
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = catalog.queries()[name](spark, SF_DIR).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    value = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else x
    plain = lambda f: sorted(repr([value(x) for x in r]) for r in f[order].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)
