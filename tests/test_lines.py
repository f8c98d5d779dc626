"""The order items hold every line of the given table."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources.tpch import numbered_lines, order_to_cash

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
def test_items_are_all_lines(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    items = order_to_cash(spark, FOLDER)["sales_order_items"]
    assert items.count() == lines.count() == items.select("salesorder", "salesorderitem").distinct().count()
    pairs = lines.select(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).distinct()
    assert items.select("salesorder", "material").distinct().exceptAll(pairs).count() == 0
    assert pairs.exceptAll(items.select("salesorder", "material").distinct()).count() == 0


def test_repeated_line_numbers_and_equal_lines(spark):
    schema = (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    )
    rows = [(1, p, 5, n, 1.0, 2.0, 0.0, 0.0, "N", "O", None) for p, n in ((9, 1), (3, 1), (3, 1), (4, None), (7, 2))]
    found = numbered_lines(spark.createDataFrame(rows, schema)).orderBy("ln").select("ln", "partkey").collect()
    assert [tuple(r) for r in found] == [(1, 4), (2, 3), (3, 3), (4, 9), (5, 7)]
