"""Graph tables on disk: versions behind a pointer, one folder per node or edge type.

    path/versions/<version>/nodes/node_type=.../    rows in order of their ids
                            edges/edge_type=.../
                            files/                  one row per file: type, rows, ranges of its ids
                            absent/                 ids that edges lead to, but no node has
    path/current/<version>                          empty; the last name is the current version

A version is written and checked where no reader looks, and becomes current by the
creation of one empty file. Whatever a writer dies of, readers find a whole graph:
the old one before that moment, the new one after it. A graph that was opened
stays on its version; the one before the current is kept for such readers.

Rows are sorted by id over all files of a type, so a page or a few ids concern the few
files whose ranges hold them, which are looked up in the table of files. Within a
file Bloom filters of the ids skip row groups.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import graph_checks
from ledgerloom.operators.graph_build import EDGE_COLUMNS, NODE_COLUMNS
from ledgerloom.session import delete, freed_shuffles, names, release, stage, touch

NODE_SCHEMA = ", ".join(f"{c} string" for c in NODE_COLUMNS)
EDGE_SCHEMA = ", ".join(f"{c} string" for c in EDGE_COLUMNS)
# Versions that stay when a new one becomes current: that one and its predecessor.
KEPT = 2
# Ids that are looked up in the table of files; more are joined.
FEW = 100
# Distinct ids that a Bloom filter is made for; it takes about 1.2 bytes each.
LEAST_DISTINCT, MOST_DISTINCT = 1_000, 500_000
# Table, id that rows are ordered by, type, and all columns with Bloom filters and ranges.
KINDS = {
    "nodes": ("node_id", "node_type", ("node_id",)),
    "edges": ("edge_id", "edge_type", ("edge_id", "source_id", "target_id")),
}
_SCHEMAS = {"nodes": NODE_SCHEMA, "edges": EDGE_SCHEMA}
_COLUMNS = {"nodes": NODE_COLUMNS, "edges": EDGE_COLUMNS}


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


class StoredGraph(Graph):
    """A graph on one version of its files, wherever the pointer goes meanwhile."""

    root: str
    files: DataFrame
    absent: DataFrame

    def part(self, kind: str, files: list[str]) -> DataFrame:
        """The rows of some files of a table."""
        rows = self.nodes if kind == "nodes" else self.edges
        if not files:
            return rows.limit(0)
        base = posixpath.join(self.root, kind)
        read = rows.sparkSession.read.schema(_SCHEMAS[kind]).option("basePath", base)
        return read.parquet(*[posixpath.join(base, f) for f in files]).select(*_COLUMNS[kind])

    def having(self, kind: str, column: str, ids: list[str]) -> DataFrame:
        """The rows with one of a few ids, from the files whose ranges hold them."""
        bounds = F.col("ranges")[column]
        held = [bounds["low"].isNotNull() & (bounds["low"] <= x) & (bounds["high"] >= x) for x in ids]
        files = self.files.filter((F.col("kind") == kind) & _any(held)).select("file")
        return self.part(kind, [r[0] for r in files.collect()]).filter(F.col(column).isin(ids))

    def page(self, kind: str, limit: int, after_id: str | None, types: list[str] | None = None) -> tuple[DataFrame, int]:
        """The first ``limit`` rows behind an id, by id, and the number of all rows of the ``types``.

        Of the files that lie wholly behind the id as many are counted as surely
        have ``limit`` rows. No row of the page lies behind their last id, so only files that
        begin before it are read.
        """
        key, type_column, _ = KINDS[kind]
        mine = self.files.filter(F.col("kind") == kind)
        if types is not None:
            mine = mine.filter(F.col("type").isin(types))
        total = mine.agg(F.sum("rows")).first()[0] or 0
        low, high = F.col("ranges")[key]["low"], F.col("ranges")[key]["high"]
        left = mine if after_id is None else mine.filter(high > after_id)
        whole = left if after_id is None else left.filter(low > after_id)
        rows, last = 0, None
        for end, n in whole.select(high.alias("high"), "rows").orderBy("high").limit(limit).collect():
            rows += n
            if rows >= limit:
                last = end
                break
        needed = left if last is None else left.filter(low <= last)
        found = self.part(kind, [r[0] for r in needed.select("file").collect()])
        found = found if after_id is None else found.filter(F.col(key) > after_id)
        return found.orderBy(key).limit(limit), total


def _any(conditions: list):
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def few_ids(ids: DataFrame, column: str) -> list[str] | None:
    """The distinct non-null ids if there are few of them."""
    found = ids.select(column).dropna().distinct().limit(FEW + 1).collect()
    return [r[0] for r in found] if len(found) <= FEW else None


class GraphIntegrityError(ValueError):
    """An id is missing or used twice."""


def _violations(rows: DataFrame, id_column: str, required: tuple[str, ...]) -> int:
    """Ids that occur more than once plus rows that lack a required value, from one pass."""
    lacks = _any([F.col(c).isNull() for c in required])
    per_id = rows.groupBy(id_column).agg(F.count("*").alias("rows"), F.count_if(lacks).alias("lacking"))
    repeated = F.count_if(F.col(id_column).isNotNull() & (F.col("rows") > 1))
    return per_id.agg(repeated + F.coalesce(F.sum("lacking"), F.lit(0))).first()[0]


def _write(parts: Sequence[DataFrame], root: str, kind: str, staged: bool, expected: int | None = None) -> None:
    key, type_column, ids = KINDS[kind]
    # Ranges are drawn from a sample, which would compute rows that are no files yet a second time.
    owner = f"graph-store-{uuid.uuid4().hex}"
    given = [rows.select(*_COLUMNS[kind]) for rows in parts]
    given = given if staged else [stage(rows, kind, owner=owner) for rows in given]
    # Types share the rows unevenly, and a row group holds so many at most.
    count = sum(rows.count() for rows in given) if expected is None else expected
    distinct = min(MOST_DISTINCT, max(LEAST_DISTINCT, count // 4))
    for rows in given:
        ordered = rows.repartitionByRange(type_column, key).sortWithinPartitions(type_column, key)
        # Ids and texts repeat their beginnings, of which this leaves much less than the default.
        writer = ordered.write.mode("append").option("compression", "zstd").partitionBy(type_column)
        for column in ids:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
            writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct))
        writer.parquet(posixpath.join(root, kind))
    if not staged:
        release(parts[0].sparkSession, owner)


def _describe(spark: SparkSession, root: str) -> None:
    """Write the table of files, from the ids of the written rows."""
    found = None
    for kind, (_, type_column, ids) in KINDS.items():
        read = spark.read.schema(_SCHEMAS[kind]).parquet(posixpath.join(root, kind))
        rows = read.select(F.col(type_column).alias("type"), F.col("_metadata.file_path").alias("path"), *ids)
        ranges = [F.struct(F.min(c).alias("low"), F.max(c).alias("high")) for c in ids]
        named = F.create_map(*[x for c, r in zip(ids, ranges, strict=True) for x in (F.lit(c), r)])
        files = rows.groupBy("type", "path").agg(F.count("*").alias("rows"), named.alias("ranges"))
        file = F.regexp_extract("path", "([^/]*/[^/]*)$", 1).alias("file")
        files = files.select(F.lit(kind).alias("kind"), "type", file, "rows", "ranges")
        found = files if found is None else found.unionByName(files)
    found.write.parquet(posixpath.join(root, "files"))


def write_graph(
    graph: Graph,
    path: str,
    strict: bool = True,
    staged: bool = False,
    expected: int | None = None,
    parts: tuple[Sequence[DataFrame], Sequence[DataFrame]] | None = None,
) -> StoredGraph:
    """Write a new version of the graph under ``path`` and make it the current one.

    ``strict`` raises when ids are missing or repeated; the check reads the id columns of
    the written tables, and the old version stays current. Otherwise the smallest row
    per id is kept and rows without an id are left out. ``staged`` tells that the tables are
    read from files, or are quick to make anew, so that they need not be written a first time to
    be sorted. ``expected`` is about how many rows either has, which sizes the Bloom filters; without
    it they are counted. ``parts`` are the nodes and the edges of the graph again, in several frames
    that have no type in common: sorted and written one by one, so that the shuffle of one is gone
    before the next.
    """
    with freed_shuffles(graph.nodes.sparkSession):
        return _write_graph(graph, path, strict, staged, expected, parts)


def _write_graph(
    graph: Graph,
    path: str,
    strict: bool,
    staged: bool,
    expected: int | None,
    parts: tuple[Sequence[DataFrame], Sequence[DataFrame]] | None,
) -> StoredGraph:
    spark = graph.nodes.sparkSession
    nodes, edges = parts or ([graph.nodes], [graph.edges])
    if not strict:
        nodes = [graph_checks.keep_first(graph.nodes, "node_id")]
        edges = [graph_checks.keep_first(graph.edges, "edge_id")]
    last = versions(spark, path)[-1:]
    number = int(last[0].partition("-")[0]) + 1 if last else 1
    version = f"{number:012}-{uuid.uuid4().hex}"
    root = posixpath.join(path, "versions", version)
    _write(nodes, root, "nodes", staged and strict, expected)
    _write(edges, root, "edges", staged and strict, expected)
    written = Graph(*(spark.read.schema(s).parquet(posixpath.join(root, k)) for k, s in _SCHEMAS.items()))
    if strict:
        bad_nodes = _violations(written.nodes, "node_id", ("node_id", "label"))
        bad_edges = _violations(written.edges, "edge_id", ("edge_id", "source_id", "target_id"))
        if bad_nodes or bad_edges:
            delete(spark, root)
            raise GraphIntegrityError(f"{bad_nodes} node ids and {bad_edges} edge ids are missing or repeated")
    _describe(spark, root)
    graph_checks.absent_ends(*written).write.parquet(posixpath.join(root, "absent"))
    touch(spark, posixpath.join(path, "current", version))
    for old in versions(spark, path)[:-KEPT]:
        delete(spark, posixpath.join(path, "current", old))
        delete(spark, posixpath.join(path, "versions", old))
    return read_graph(spark, path, version)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Versions that became current and are still there, the current one last."""
    return names(spark, posixpath.join(path, "current"))


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete versions that never became current, as writers that died leave them; no writer may be at work."""
    lost = sorted(set(names(spark, posixpath.join(path, "versions"))) - set(versions(spark, path)))
    for version in lost:
        delete(spark, posixpath.join(path, "versions", version))
    return lost


def read_graph(spark: SparkSession, path: str, version: str | None = None) -> StoredGraph:
    """The graph as it is now, or one of its kept ``versions``."""
    known = versions(spark, path)
    if not known or version not in (None, *known):
        raise FileNotFoundError(f"no graph under {path}" if not known else f"{path} has no version {version}")
    root = posixpath.join(path, "versions", version or known[-1])
    tables = [
        spark.read.schema(_SCHEMAS[k]).parquet(posixpath.join(root, k)).select(*_COLUMNS[k]) for k in ("nodes", "edges")
    ]
    stored = StoredGraph(*tables)
    stored.root = root
    stored.files = spark.read.parquet(posixpath.join(root, "files"))
    stored.absent = spark.read.parquet(posixpath.join(root, "absent"))
    return stored


def counts(graph: Graph) -> DataFrame:
    """``(table, rows)`` of the two graph tables; of a stored graph from its table of files."""
    if isinstance(graph, StoredGraph):
        table = F.concat(F.lit("graph_"), F.col("kind")).alias("table")
        zeros = graph.files.sparkSession.createDataFrame([(f"graph_{k}", 0) for k in KINDS], "table string, rows long")
        return graph.files.select(table, "rows").unionByName(zeros).groupBy("table").agg(F.sum("rows").alias("rows"))
    parts = [
        rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, rows in (("graph_nodes", graph.nodes), ("graph_edges", graph.edges))
    ]
    return parts[0].unionByName(parts[1])
