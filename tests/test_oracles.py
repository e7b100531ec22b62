"""Every core query that has SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from codeweft.plans import code_queries, graph_queries, problems

DIR = "/root/testdata/sf0.001"
QUERIES = {**graph_queries.QUERIES, **problems.QUERIES}
ORACLES = {**graph_queries.ORACLES, **problems.ORACLES}
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def canon(df):
    def one(v):
        return "~" if pd.isna(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(map(one, r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, db, name):
    assert canon(QUERIES[name](spark, DIR).toPandas()) == canon(db.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(code_queries.QUERIES))
def test_code_queries_run(spark, name):
    assert code_queries.QUERIES[name](spark, DIR).columns
