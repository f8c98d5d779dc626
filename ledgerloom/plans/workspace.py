"""The given tables as an order-to-cash dataset, prepared once per session.

Like a load before querying: the numbered line items and the built graph are
written to the staging folder when a query first needs them, and every query
reads from there. No query result is kept. A workspace belongs to the files it
was made from: when one of them changes, the next query opens a new one and what
the old one staged is deleted.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import graph_build, graph_checks, graph_query
from ledgerloom.session import release, side_by_side, stage, staging_path, tune
from ledgerloom.sources import ingest, jsonl
from ledgerloom.sources.catalog import CORE_COLLECTIONS, Collections
from ledgerloom.sources.graph_store import Graph, StoredGraph, write_graph
from ledgerloom.sources.tpch import BILLING_BASE, order_to_cash

_open: dict[tuple[str, str], Workspace] = {}

# Tables a workspace reads.
TABLES = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region", "conversations")

# Example prompts.
EXAMPLE_PROMPTS = (
    "Which products are associated with the highest number of billing documents?",
    "Show me the top 5 products by billing count",
    "show me the top 5 products",
    "Show me all broken flows",
    "Trace billing document 90504248",
    "Trace a billing document",
    "trace invoice 90504248",
    "Explore the graph",
    "What's the weather today?",
    "Who won the Super Bowl?",
    "Tell me a joke",
    "hello",
    "",
)


# Files each collection is written to as JSON lines, and what they are called.
FILES_EACH = 4
FILES = ("part-*.txt.gz",)
# Lines that loading must reject, one per row of the table named.
BAD_LINES = {
    "sales_order_headers": (("nation", "no record"),),
    "outbound_delivery_headers": (("region", '["deliverydocument"]'),),
    "billing_document_headers": (("region", '{"billingdocumentiscancelled": "maybe"}'),),
    "business_partners": (("nation", '{"businesspartner": "x"} trailing'), ("region", "{}")),
    "products": (("region", "{'product': 'x'}"), ("nation", '{"product": "x"}{"product": "y"}')),
    "plants": (("region", '{"plant": "x", "unknown": 1}'),),
}


class Workspace:
    """Collections, graph and prompts of one table folder."""

    def __init__(self, spark: SparkSession, folder: str, files: tuple = ()):
        self.files = files
        self.spark = tune(spark, sum(size for _, size, _ in files))
        self.folder = folder
        self.owner = f"workspace-{uuid.uuid4().hex}"
        self.tables: Collections = order_to_cash(spark, folder, self.owner)
        self._jsonl_written: set[str] = set()

    def prepare(self) -> None:
        """Stage the tables all collections are projections of."""
        for name in ("sales_order_items", "billing_document_headers", "outbound_delivery_headers"):
            self.tables[name]

    @property
    def graph(self) -> Graph:
        """The graph: as the store has it if a query needed that, else built as it is read.

        Types and texts that a query leaves out are then neither built nor written, and what it
        reads takes less disk as the short columns it is made from than as finished rows.
        """
        if "stored" in self.__dict__:
            return Graph(self.stored.nodes, self.stored.edges)
        return self._built

    @cached_property
    def _built(self) -> Graph:
        return Graph(graph_build.build_nodes(self.tables), graph_build.build_edges(self.tables))

    def links(self, types: Sequence[str], depth: int) -> DataFrame:
        """Edges that subgraphs deeper than one hop follow from nodes of ``types``, as files."""
        if "stored" in self.__dict__:
            return self.stored.edges
        return stage(graph_query.links(self.graph.edges, types, depth), "links", "edge_type", self.owner)

    @cached_property
    def pairs(self) -> DataFrame:
        """``edge_type`` and ends of all edges, each pair of ids once."""
        return graph_build.build_links(self.tables)

    @cached_property
    def absent(self) -> DataFrame:
        """Ids that edges of the graph lead to, but no node has."""
        if "stored" in self.__dict__:
            return self.stored.absent
        return graph_checks.absent_ends(*graph_build.repeating(self.tables))

    @cached_property
    def stored(self) -> StoredGraph:
        """The graph as the graph store lays it out, for what reads parts of it."""
        return self.write_graph("graph")

    def write_graph(self, name: str) -> StoredGraph:
        """The graph written anew in a folder of its own.

        Its rows come out of a shuffle of short columns, which Spark keeps, so only their texts are
        made twice to draw ranges. Nodes are at most as many as the rows of their collections, and edges
        about as many as the larger one of their ends.
        """
        rows = {name: self.tables[kind.collection].count() for name, kind in graph_build.NODE_KINDS.items()}
        edges = {name: max(rows[source], rows[target]) for name, (source, target) in graph_build.EDGE_ENDS.items()}
        parts = tuple(
            [reduce(DataFrame.unionByName, [make(self.tables, name) for name in names]) for names in _dealt(sizes)]
            for make, sizes in ((graph_build.nodes_of_type, rows), (graph_build.edges_of_type, edges))
        )
        path = staging_path(self.spark, name, self.owner)
        return write_graph(self.graph, path, staged=True, expected=sum(rows.values()), parts=parts)

    @cached_property
    def jsonl_root(self) -> str:
        """Folder with the core collections as JSON lines, four files each, and lines that must be rejected."""
        folder = self._jsonl_folder
        self.prepare()
        side_by_side(self.spark, self.jsonl, CORE_COLLECTIONS)
        return folder

    @cached_property
    def _jsonl_folder(self) -> str:
        return staging_path(self.spark, "jsonl", self.owner)

    def jsonl(self, name: str) -> str:
        """Folder of one collection as JSON lines, written when first asked for.

        Nations and regions give the bad lines, one kind to a collection; a good line
        comes first. Rows go to the files as they are read, with nothing shuffled or
        sorted; where that leaves a file out or a bad line first, they are dealt evenly.
        """
        path = posixpath.join(self._jsonl_folder, name)
        if name not in self._jsonl_written:
            good = self.tables[name].select(
                F.lit(False).alias("bad"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")
            )
            bad = BAD_LINES.get(name, ())
            for table, line in bad:
                good = good.unionByName(self.given(table).select(F.lit(True).alias("bad"), F.lit(line).alias("value")))
            _write_lines(good.coalesce(FILES_EACH), path)
            written = jsonl.Source(self.spark, path, name, FILES)
            if written.files != FILES_EACH or written.first_line() in [line for _, line in bad]:
                _write_lines(good.repartition(FILES_EACH).sortWithinPartitions("bad"), path)
            self._jsonl_written.add(name)
        return path

    @cached_property
    def ingested(self) -> tuple[str, DataFrame]:
        """Folder with the tables ingested from the JSON lines, and the report of that."""
        out = staging_path(self.spark, "ingested", self.owner)
        return out, ingest.ingest(self.spark, self.jsonl_root, out, patterns=FILES)

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(posixpath.join(self.folder, f"{name}.parquet"))

    def prompts(self) -> DataFrame:
        """``(prompt_id, prompt)``: what users say, and a question for each document and product.

        ``conversations`` gives real text in several languages; the tables give
        a trace request per billing document, a ranking request per part size
        and a broken-flow request per customer segment.
        """
        said = (
            self.given("conversations")
            .filter(F.col("role") == "user")
            .select(
                F.concat(F.lit("said-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")),
                "text",
            )
            .toDF("prompt_id", "prompt")
        )
        document = F.col("salesorder").cast("bigint")
        traced = self.tables["sales_order_headers"].select(
            F.concat(F.lit("trace-"), F.col("salesorder")).alias("prompt_id"),
            F.concat(F.lit("Trace billing document "), (F.lit(BILLING_BASE) + document).cast("string")).alias("prompt"),
        )
        ranked = self.given("part").select(
            F.concat(F.lit("rank-"), F.col("p_partkey").cast("string")).alias("prompt_id"),
            F.concat(F.lit("List the top "), F.col("p_size").cast("string"), F.lit(" products by billing")).alias(
                "prompt"
            ),
        )
        broken = self.tables["business_partners"].select(
            F.concat(F.lit("broken-"), F.col("businesspartner")).alias("prompt_id"),
            F.concat(F.lit("Which orders of "), F.col("businesspartnercategory"), F.lit(" are incomplete?")).alias(
                "prompt"
            ),
        )
        examples = self.spark.createDataFrame(
            [(f"example-{i}", text) for i, text in enumerate(EXAMPLE_PROMPTS)], "prompt_id string, prompt string"
        )
        return said.unionByName(traced).unionByName(ranked).unionByName(broken).unionByName(examples)


def _dealt(sizes: dict[str, int]) -> list[list[str]]:
    """Names in as few groups as have hardly more rows each than the largest of them alone."""
    groups: list[list[str]] = []
    left = 0
    for name in sorted(sizes, key=sizes.get, reverse=True):
        if not groups or sizes[name] > left:
            groups.append([])
            left = max(sizes.values())
        groups[-1].append(name)
        left -= sizes[name]
    return groups


def _write_lines(lines: DataFrame, path: str) -> None:
    # Lines repeat their keys, so the quickest compression leaves a small part of them.
    writer = lines.select("value").write.mode("overwrite").option("compression", "gzip")
    writer.option("zlib.compress.level", "BEST_SPEED").text(path)


def table_files(spark: SparkSession, folder: str) -> tuple:
    """Path, size and time of change of all files of the tables, in order."""
    paths = [posixpath.join(folder, f"{name}.parquet") for name in TABLES]
    listed = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    return tuple(sorted(tuple(row) for row in listed.collect()))


def open_workspace(spark: SparkSession, folder: str) -> Workspace:
    """The workspace of ``folder`` as its files are now."""
    key = (spark.sparkContext.applicationId, posixpath.normpath(folder))
    files = table_files(spark, folder)
    found = _open.get(key)
    if found is None or found.files != files:
        if found is not None:
            release(spark, found.owner)
        _open[key] = Workspace(spark, folder, files)
    return _open[key]
