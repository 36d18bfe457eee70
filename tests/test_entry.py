"""Every query of the alignment operators against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def canon(df: pd.DataFrame) -> list:
    cell = lambda v: "~" if pd.isna(v) else format(float(v), ".10g") if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.SQL:
        want = duck.execute(plans.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_entry(spark):
    import __spark_entry__ as repo

    assert repo.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(repo.queries()) and set(plans.SQL) <= set(repo.oracle_sql())
