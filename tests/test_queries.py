"""Every query against its SQL in DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quarry import queries, rules

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df: pd.DataFrame) -> list:
    value = lambda x: "null" if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    df = df[sorted(df.columns)]
    return sorted(tuple(value(x) for x in r) for r in df.itertuples(index=False))


QUERIES, ORACLES = queries.QUERIES | rules.QUERIES, queries.ORACLES | rules.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry(spark):
    assert queries.entry(spark, SF).count() > 0
