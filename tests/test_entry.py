"""Every registered query against its SQL twin, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from climspark.checks.oracle import ORACLE
from climspark.checks.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    return str(value) if isinstance(value, str) else str(float(value) + 0.0)


def rows(pdf):
    names = sorted(pdf.columns)
    return names, sorted(tuple(map(str, map(plain, r))) for r in pdf[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    assert len(got) > 0
    assert rows(got) == rows(duck.sql(ORACLE[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(driver.queries())
    assert set(ORACLE) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    out = driver.entry(spark)
    assert out.columns == ["station", "date", "latitude", "longitude", "altitude", "y_pred_full"]
    assert out.count() == 10 * 730
