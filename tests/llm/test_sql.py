"""The queries that have SQL against it, on a table folder."""

import os

import duckdb
import pytest

from ledgerloom.llm.queries import QUERIES
from ledgerloom.llm.sql import SQL
from tools.check_queries import rows_of

FOLDER = os.environ.get("TEST_LLM_SQL_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
@pytest.mark.parametrize("name", SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df, result = QUERIES[name](spark, FOLDER), con.execute(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 1 + len(QUERIES)))
