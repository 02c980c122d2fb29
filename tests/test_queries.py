"""Every query that has SQL gives the same rows as DuckDB."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cogspark import plans
from cogspark.plans.registry import GIVEN

SF = "/root/testdata/sf0.001"
SQL = plans.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in GIVEN:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (bool, np.bool_, int, float, np.integer, np.floating)):
        return f"{float(v):.6g}"
    return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    got, want = rows(plans.queries()[name](spark, SF).toPandas()), rows(duck.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_queries_without_sql_run(spark):
    for name, f in plans.queries().items():
        if name not in SQL:
            assert f(spark, SF).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
