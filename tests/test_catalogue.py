"""Every query against its SQL in a second engine, over whole tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from strandline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def text(v) -> str:
    if hasattr(v, "__len__") and not isinstance(v, str):
        return repr([text(x) for x in v])
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return f"{float(v):.6g}" if isinstance(v, (int, float, np.number)) else str(v)


def plain(df):
    return sorted(tuple(text(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, engine, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), engine.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(catalogue.SQL) <= set(entry.oracle_sql()) and set(catalogue.QUERIES) <= set(entry.queries())
