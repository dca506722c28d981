"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quillon.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return f"{float(v):.6g}" if type(v).__name__ in ("float", "float64", "Decimal") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(str([plain(v) for v in r]) for r in df.astype(object).values.tolist()), list(df.columns)


def close(a, b):
    if a == b:
        return True
    norm = lambda t: [x.replace(".0'", "'") for x in t]  # noqa: E731  whole numbers as floats
    return norm(a) == norm(b)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    got, columns = rows(registry.QUERIES[name](spark, SF).toPandas())
    want, names = rows(duck.execute(registry.ORACLES[name]).df())
    assert columns == names
    assert len(got) == len(want)
    assert close(got, want)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.count() >= 0
    assert registry.QUERIES[name](spark, SF).schema == df.schema
