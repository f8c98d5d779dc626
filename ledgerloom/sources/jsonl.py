"""Partitioned JSON-lines collections.

A collection is a folder of ``part-*.jsonl`` files (or other ``*.jsonl`` files
when there are none) or one such file. Its columns are those of the first
record; later records may lack some, but a record with an unknown key, with a
value its column cannot hold, or that is not one strict JSON object is rejected.
So is an object without members, but for item collections, whose key column
makes it a row.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.keys import loaded_item_key
from ledgerloom.sources.catalog import ITEM_KEY_COLUMN, ITEM_KEYS, sanitize

SUFFIX = ".jsonl"
FILE_PATTERNS = ("part-*.jsonl", "*.jsonl")
REJECTED = "_rejected"
# Why a line is rejected.
NO_OBJECT, NO_MEMBERS, UNKNOWN_KEY, WRONG_VALUE = "not one JSON object", "no members", "unknown key", "wrong value"
STRICT = {"allowSingleQuotes": "false"}


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame | None:
    """Paths of the files at ``path`` that match ``pattern``; None when there is no such path."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    try:
        return reader.load(path).select("path")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def resolve_path(spark: SparkSession, path: str, name: str) -> str:
    """``path`` if it exists, else the folder it was meant to be."""
    candidates = [path, posixpath.join(path, name)]
    if path.endswith(SUFFIX):
        candidates.insert(1, path[: -len(SUFFIX)])
    for candidate in candidates:
        if list_files(spark, candidate) is not None:
            return candidate
    return path


def _regex(pattern: str) -> str:
    """A file name pattern with ``*`` and ``?`` as a regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


class Source:
    """The files that make up one collection: those of the first pattern that any file matches."""

    def __init__(self, spark: SparkSession, path: str, name: str, patterns: Sequence[str] = FILE_PATTERNS):
        self.spark = spark
        self.name = name
        self.path = resolve_path(spark, path, name)
        self.pattern = "*"
        self.files = 0
        self.first_file: str | None = None
        listed = list_files(spark, self.path)
        if listed is None:
            return
        file_name = F.url_decode(F.substring_index("path", "/", -1))
        matches = [F.when(file_name.rlike(_regex(pattern)), F.col("path")) for pattern in patterns]
        found = listed.agg(*[f(m) for m in matches for f in (F.count, F.min)]).first()
        for k, pattern in enumerate(patterns):
            if found[2 * k]:
                self.pattern, self.files, self.first_file = pattern, found[2 * k], found[2 * k + 1]
                break

    def lines(self) -> DataFrame:
        """One row per line that is not blank."""
        return self._lines_at(self.path, self.pattern)

    def _lines_at(self, path: str, pattern: str) -> DataFrame:
        return self.spark.read.option("pathGlobFilter", pattern).text(path).filter(F.col("value").rlike(r"(?U)\S"))

    def first_line(self) -> str | None:
        """First line of the first file that is not blank."""
        row = None if self.first_file is None else self._lines_at(self.first_file, "*").first()
        return row[0] if row else None

    def sample(self) -> dict[str, Any]:
        """First record of the first file."""
        line = self.first_line()
        return json.loads(line) if line else {}


def column_type(value: Any) -> str:
    """Spark type of a column whose first value is ``value``."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint"
    if isinstance(value, float):
        return "double"
    return "string"


def _convert(text: Column, kind: str) -> Column:
    if kind == "bigint":
        return F.coalesce(text.try_cast("bigint"), F.rint(text.try_cast("double")).try_cast("bigint"))
    return text if kind == "string" else text.try_cast(kind)


def _judged(source: Source) -> tuple[DataFrame, dict[str, Column]] | None:
    """Lines as parsed, with the ``reason`` to reject them (null for good ones), and the columns they make."""
    sample = source.sample()
    if not sample:
        return None
    kinds = {key: column_type(value) for key, value in sample.items()}
    shape = ", ".join(f"`{key.replace('`', '``')}` string" for key in kinds)
    known = F.array(*[F.lit(sanitize(key)) for key in kinds])

    # In brackets, a line must be the only element of a whole array: nothing may follow its object.
    alone = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<map<string,string>>", STRICT)
    # Behind a generator nothing that uses what was parsed can parse it again, nor can a filter on the reason.
    once = F.inline(F.array(F.struct(alone.alias("alone"))))
    parsed = source.lines().select("value", F.col("_metadata.file_path").alias("file"), once)
    found = F.col("alone")[0]
    parsed = parsed.withColumn("keys", F.when(F.size("alone") == 1, F.map_keys(found)))
    # A line with the keys of the first one, in their order, is read by position; any other is parsed once more by name.
    parsed = parsed.withColumn("usual", F.coalesce(F.col("keys") == F.array(*map(F.lit, kinds)), F.lit(False)))
    parsed = parsed.withColumn("other", F.when(~F.col("usual"), F.from_json("value", shape, STRICT)))
    spelled = F.transform("keys", lambda k: F.lower(F.translate(k, " -", "__")))
    unknown = F.when(~F.col("usual"), F.array_except(spelled, known))
    reason = F.when(F.col("keys").isNull(), NO_OBJECT).when(
        F.size(unknown) > 0, F.concat(F.lit(f"{UNKNOWN_KEY}: "), F.array_join(F.array_sort(unknown), ", "))
    )
    if source.name not in ITEM_KEYS:
        reason = reason.when(F.size("keys") == 0, NO_MEMBERS)
    columns = {}
    for position, (key, kind) in enumerate(kinds.items()):
        text = F.when(F.col("usual"), F.map_values(found)[position]).otherwise(F.col("other").getField(key))
        columns[sanitize(key)] = _convert(text, kind)
        if kind != "string":
            reason = reason.when(text.isNotNull() & columns[sanitize(key)].isNull(), f"{WRONG_VALUE}: {sanitize(key)}")
    return parsed.withColumn("reason", reason), columns


def scan(source: Source) -> DataFrame | None:
    """All records of a collection with sanitised columns and a ``_rejected`` flag.

    Nested values stay as JSON text. None when the collection has no record.
    """
    judged = _judged(source)
    if judged is None:
        return None
    lines, columns = judged
    rejected = F.col("reason").isNotNull().alias(REJECTED)
    loaded = lines.select(*[value.alias(name) for name, value in columns.items()], rejected)
    if source.name in ITEM_KEYS:
        document, item = (
            F.col(c) if c in loaded.columns else F.lit(None).cast("string") for c in ITEM_KEYS[source.name]
        )
        loaded = loaded.withColumn(ITEM_KEY_COLUMN, loaded_item_key(document, item))
    return loaded


def rejected_lines(source: Source) -> DataFrame | None:
    """``(collection, file, line, reason)`` of the lines that loading rejects; the first reason that applies."""
    judged = _judged(source)
    if judged is None:
        return None
    bad = judged[0].filter(F.col("reason").isNotNull())
    return bad.select(F.lit(source.name).alias("collection"), "file", F.col("value").alias("line"), "reason")


def read_collection(
    spark: SparkSession, path: str, name: str, patterns: Sequence[str] = FILE_PATTERNS
) -> DataFrame | None:
    """Accepted records of a collection."""
    records = scan(Source(spark, path, name, patterns))
    return None if records is None else records.filter(~F.col(REJECTED)).drop(REJECTED)


def load_stats(records: DataFrame, name: str) -> DataFrame:
    """``(collection, inserted, errors)`` of a scan."""
    return records.agg(
        F.count_if(~F.col(REJECTED)).alias("inserted"), F.count_if(F.col(REJECTED)).alias("errors")
    ).select(F.lit(name).alias("collection"), "inserted", "errors")
