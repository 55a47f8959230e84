"""Every query of the library against its SQL on the smallest tables, and the ones without SQL against simple rules."""

import os

import duckdb
import pandas as pd
import pytest

from waveloom.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _value(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return str([_value(x) for x in v])
    if pd.isna(v):
        return "None"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(_value, r)) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert rows(Q[name](spark, DATA).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs_without_nulls_in_keys(spark, name):
    df = Q[name](spark, DATA)
    got = df.toPandas()
    assert len(got) and got[df.columns[0]].notna().all()


def test_flagship(spark):
    assert registry.flagship(spark, DATA).count()
