"""Every query runs and, where it has SQL, agrees with it."""
import math

import duckdb
import pandas as pd
import pytest

from strandloom.plans import catalog

ALL = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck(data):
    import glob
    import os

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _norm(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if type(v).__name__ == "Decimal":
        v = float(v)
    return str(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", ALL)
def test_query(spark, data, duck, name):
    df = catalog.queries()[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    sql = catalog.sql().get(name)
    if not sql:
        return
    q = duck.execute(sql)
    at = {x[0]: i for i, x in enumerate(q.description)}
    assert sorted(at) == cols
    assert sorted(tuple(_norm(r[at[c]]) for c in cols) for r in q.fetchall()) == rows


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
