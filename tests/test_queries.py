"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from locusframe import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def cell(x):
    import pandas as pd

    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "~"
    if isinstance(x, (list, tuple)) or hasattr(x, "__len__") and not isinstance(x, (str, bytes)):
        return str([cell(v) for v in x])
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return str(x)
    return f"{float(x):.6g}" if isinstance(x, (int, float)) and abs(x) < 2**53 else str(x)


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(cell(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    out = catalog.QUERIES[name](spark, DATA).toPandas()
    if name in catalog.ORACLES:
        assert table(out) == table(duck.execute(catalog.ORACLES[name]).df())
    else:
        assert len(out) > 0


def test_entry_has_all():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
