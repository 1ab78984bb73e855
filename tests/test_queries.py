"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import math
import os
from glob import glob

import duckdb
import pandas as pd
import pytest

from palimpsest.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    return int(x) if isinstance(x, float) and x.is_integer() else x


def rows(df):
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLES.keys() and len(QUERIES) > 45


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want) > 0
    assert rows(got) == rows(want)
