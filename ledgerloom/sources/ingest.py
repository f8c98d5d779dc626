"""Full-refresh ingest of a dataset folder into parquet tables, and its reports."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import delete, side_by_side
from ledgerloom.session import names as names_in
from ledgerloom.sources import jsonl
from ledgerloom.sources.catalog import (
    COLLECTIONS,
    CORE_COLLECTIONS,
    OPTIONAL_COLLECTIONS,
    Collections,
    empty,
)

# Folder of the rejected lines, beside the tables.
REJECTED_FOLDER = "_rejected"
REJECTED_LINES = "collection string, file string, line string, reason string"
REPORT = "collection string, inserted bigint, errors bigint, files bigint"


def open_dataset(
    spark: SparkSession, root: str, patterns: Sequence[str] = jsonl.FILE_PATTERNS
) -> Collections:
    """Collections read straight from the JSON lines under ``root``."""
    sources = {}
    for name in COLLECTIONS:
        path = posixpath.join(root, name)
        if jsonl.list_files(spark, path) is not None:
            sources[name] = lambda path=path, name=name: jsonl.read_collection(spark, path, name, patterns)
    return Collections(spark, sources)


def open_tables(spark: SparkSession, out: str) -> Collections:
    """Collections written by :func:`ingest`."""
    sources = {}
    for name in COLLECTIONS:
        path = posixpath.join(out, name)
        if jsonl.list_files(spark, path) is not None:
            sources[name] = lambda path=path: spark.read.parquet(path)
    return Collections(spark, sources)


def ingest(
    spark: SparkSession,
    root: str,
    out: str,
    names: Iterable[str] = CORE_COLLECTIONS,
    patterns: Sequence[str] = jsonl.FILE_PATTERNS,
) -> DataFrame:
    """Replace the tables under ``out`` with the accepted records under ``root``.

    Collections are loaded side by side, as a few files make few tasks. Each is read once: the
    counts are observed while it is written. One with rejected lines is read once more to write
    those, with file and reason; see :func:`open_rejected`. A missing or empty collection becomes
    an empty table.
    """

    def one(name: str) -> tuple[str, int, int, int]:
        delete(spark, posixpath.join(out, REJECTED_FOLDER, name))
        source = jsonl.Source(spark, posixpath.join(root, name), name, patterns)
        records = jsonl.scan(source) if source.files else None
        target = posixpath.join(out, name)
        if records is None:
            empty(spark, name).write.mode("overwrite").parquet(target)
            return name, 0, 0, source.files
        seen = Observation()
        rejected = F.col(jsonl.REJECTED)
        (
            records.observe(seen, F.count_if(~rejected).alias("inserted"), F.count_if(rejected).alias("errors"))
            .filter(~rejected)
            .drop(jsonl.REJECTED)
            .write.mode("overwrite")
            .parquet(target)
        )
        if seen.get["errors"]:
            bad = jsonl.rejected_lines(source).drop("collection")
            bad.write.parquet(posixpath.join(out, REJECTED_FOLDER, name))
        return name, seen.get["inserted"], seen.get["errors"], source.files

    report = side_by_side(spark, one, names)
    return spark.createDataFrame(report, REPORT)


def open_rejected(spark: SparkSession, out: str) -> DataFrame:
    """``(collection, file, line, reason)`` of what the last :func:`ingest` of each collection rejected."""
    found = spark.createDataFrame([], REJECTED_LINES)
    for name in names_in(spark, posixpath.join(out, REJECTED_FOLDER)):
        rows = spark.read.parquet(posixpath.join(out, REJECTED_FOLDER, name))
        found = found.unionByName(rows.select(F.lit(name).alias("collection"), "file", "line", "reason"))
    return found


def load_report(
    spark: SparkSession, root: str, names: Iterable[str], patterns: Sequence[str] = jsonl.FILE_PATTERNS
) -> DataFrame:
    """The ingest report without writing anything."""
    parts = []
    for name in names:
        source = jsonl.Source(spark, posixpath.join(root, name), name, patterns)
        records = jsonl.scan(source) if source.files else None
        if records is None:
            parts.append(spark.createDataFrame([(name, 0, 0, source.files)], REPORT))
        else:
            files = F.lit(source.files).cast("bigint").alias("files")
            parts.append(jsonl.load_stats(records, name).select("*", files))
    return reduce(DataFrame.unionByName, parts)


def with_total(report: DataFrame) -> DataFrame:
    """The report with a status per collection and a TOTAL row."""
    total = F.grouping("collection") == 1
    return (
        report.rollup("collection")
        .agg(
            total.alias("is_total"),
            *[F.sum(c).alias(c) for c in report.columns if c != "collection"],
        )
        .withColumn("collection", F.when(F.col("is_total"), "TOTAL").otherwise(F.col("collection")))
        .withColumn("status", F.when(F.col("errors") > 0, "warning").otherwise("ok"))
        .drop("is_total")
    )


def row_counts(tables: Collections, names: Iterable[str] = CORE_COLLECTIONS) -> DataFrame:
    """``(table, rows)`` per collection; a missing one counts 0."""
    parts = [
        tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name in names
    ]
    return reduce(DataFrame.unionByName, parts)


def collection_check(tables: Collections, names: Iterable[str] = CORE_COLLECTIONS) -> DataFrame:
    """Whether each core collection is required, and whether it is there with records.

    ``status`` is ``ok``, ``missing`` (required) or ``optional_missing``.
    """
    counts = row_counts(tables, names)
    required = ~F.col("table").isin(*OPTIONAL_COLLECTIONS)
    return counts.select(
        F.col("table").alias("collection"),
        required.alias("required"),
        "rows",
        F.when(F.col("rows") > 0, "ok").when(required, "missing").otherwise("optional_missing").alias("status"),
    )


def missing_required(spark: SparkSession, root: str) -> list[str]:
    """Required collections without a folder under ``root``."""
    return [
        name
        for name in CORE_COLLECTIONS
        if name not in OPTIONAL_COLLECTIONS and jsonl.list_files(spark, posixpath.join(root, name)) is None
    ]


def list_schema(tables: Collections, names: Iterable[str] | None = None) -> DataFrame:
    """``(collection, column, position, data_type, nullable, is_key)`` of every collection."""
    rows = []
    for name in names or COLLECTIONS:
        keys = {c.lower() for c in COLLECTIONS[name].key}
        for position, field in enumerate(tables[name].schema.fields, start=1):
            column = field.name.lower()
            rows.append((name, column, position, field.dataType.simpleString(), field.nullable, column in keys))
    return tables.spark.createDataFrame(
        rows, "collection string, column string, position int, data_type string, nullable boolean, is_key boolean"
    )


def export(df: DataFrame, path: str, file_format: str = "csv") -> None:
    """Write a result as CSV (with header) or JSON lines."""
    if file_format not in ("csv", "json"):
        raise ValueError("file_format must be csv or json")
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", "true").csv(path)
    else:
        writer.option("ignoreNullFields", "false").json(path)
