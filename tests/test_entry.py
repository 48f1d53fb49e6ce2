"""Every query against its SQL, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from basalt.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(df):
    import pandas

    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pandas.NA or v != v:
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__module__ == "numpy" and not str(v) in ("True", "False") else str(v)[:10] if hasattr(v, "year") else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None)), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_contract():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
