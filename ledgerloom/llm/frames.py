"""Small helpers for tables of documents."""

from __future__ import annotations

import posixpath
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LAST = (1 << 63) - 1
# Rows that go to a Python worker at once; texts may be long, so far fewer than Spark's 10,000.
ARROW_ROWS = "1000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(sf_dir, f"{name}.parquet"))


# The served archive by application; it goes when this process ends.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ready(spark: SparkSession) -> None:
    """Make the session fit for the operators that run Python in tasks.

    Keeps Arrow batches small, as executors hold a few of them at a time (results are
    read later, so the caller's session stays with this setting), and once
    per application gives the executors this package through Spark's file server.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.TemporaryDirectory(prefix="package-")
        archive = shutil.make_archive(f"{folder.name}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped[app] = folder


def as_row(docs: DataFrame) -> DataFrame:
    """One column ``row`` with all columns, so that no name of theirs can clash with ours."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def row_and(rows: DataFrame, more: str) -> T.StructType:
    """Schema of the column ``row`` and of ``more`` columns given as DDL."""
    return T.StructType([rows.schema["row"], *T.StructType.fromDDL(more).fields])


def repeats(docs: DataFrame) -> bool:
    """Whether any ``doc_id`` stands in more than one row."""
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def identified(docs: DataFrame, repeat: bool | None = None) -> DataFrame:
    """``row``, ``order`` (``doc_id``, null last) and ``copy``, which tells rows with one ``doc_id`` apart by text.

    ``copy`` is 0 where no ``doc_id`` repeats, which the first job here finds out
    from the ids alone, unless the caller knows.
    """
    repeat = repeats(docs) if repeat is None else repeat
    copy = F.coalesce(F.xxhash64("row.text"), F.lit(0)) if repeat else F.lit(0).cast("long")
    rows = as_row(docs)
    return rows.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST)).alias("order"), copy.alias("copy"))


def join_totals(rows: DataFrame, totals: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``totals``, an aggregate by the long ``key``, such that a hot key can be split.

    Joined by the plain key, the aggregate would meet the rows in its own
    partitions, and Spark only splits a skewed join between two shuffles that
    nothing stands on. The key's bits are flipped for the join, so that the totals
    are shuffled once more, by themselves.
    """
    flipped = totals.withColumn("_flipped", F.bitwise_not(key)).drop(key)
    joined = rows.withColumn("_flipped", F.bitwise_not(key)).join(flipped, "_flipped", how)
    return joined.drop("_flipped")
