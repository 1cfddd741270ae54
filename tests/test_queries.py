import glob
import os

import pandas as pd
import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

import __spark_entry__ as entry  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(df):
    def cell(x):
        if hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return str(x.tolist())
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
            return "null"
        return repr(round(float(x), 6)) if isinstance(x, int | float) or type(x).__name__.startswith(("int", "float")) else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, row)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    assert plain(entry.queries()[name](spark, FOLDER).toPandas()) == plain(duck.sql(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert len(entry.queries()[name](spark, FOLDER).toPandas()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
