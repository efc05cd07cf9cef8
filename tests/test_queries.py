"""Every registered query of the record engine against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from recordloom.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_against_sql(spark, duck, name):
    ours, theirs = queries()[name](spark, SF).toPandas(), duck.execute(oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)

    def rows(df):
        return sorted(tuple("" if pd.isna(v) else str(float(v)) if not isinstance(v, (str, bool)) and type(v).__name__ != "bool_" else str(v) for v in r) for r in df[columns].itertuples(index=False))

    assert rows(ours) == rows(theirs)
