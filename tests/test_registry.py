"""Each registered query against its SQL on the smallest table folder."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as spark_entry
from ledgerloom.plans.registry import REGISTRY
from tools.check_queries import TABLES, rows_of

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
QUERIES, SQL = spark_entry.queries(), spark_entry.oracle_sql()
# The graph of the given tables has no edge to an id without a node.
MAY_BE_EMPTY = {"dangling_edges"}
QUERIES = {name: QUERIES[name] for name in REGISTRY}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    ours = rows_of(df.columns, df.collect())
    result = con.execute(SQL[name])
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    assert ours == theirs
    assert isinstance(ours[1], Counter) and (ours[1] or name in MAY_BE_EMPTY)
