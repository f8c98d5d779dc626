"""Integrity of a built graph: unique and present ids, edges that lead somewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage


def id_report(rows: DataFrame, id_column: str, type_column: str) -> DataFrame:
    """Per type: rows, distinct ids, ids used more than once, rows without an id."""
    per_id = rows.groupBy(type_column, id_column).agg(F.count("*").alias("n"))
    has_id = F.col(id_column).isNotNull()
    return per_id.groupBy(type_column).agg(
        F.sum("n").alias("rows"),
        F.count_if(has_id).alias("distinct_ids"),
        F.count_if(has_id & (F.col("n") > 1)).alias("duplicated_ids"),
        F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).cast("bigint").alias("missing_ids"),
    )


def duplicate_ids(rows: DataFrame, id_column: str) -> DataFrame:
    """Ids that occur more than once, with their number of rows."""
    counted = rows.filter(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.count("*").alias("rows"))
    return counted.filter(F.col("rows") > 1)


def missing_ids(rows: DataFrame, *id_columns: str) -> DataFrame:
    """Rows in which a required column is null."""
    condition = F.lit(False)
    for column in id_columns:
        condition = condition | F.col(column).isNull()
    return rows.filter(condition)


def keep_first(rows: DataFrame, id_column: str) -> DataFrame:
    """One row per id, the smallest by the remaining columns; rows without an id are left out.

    Which ids repeat is counted from the ids alone. Only their rows are shuffled and
    compared; all others pass as they are.
    """
    others = [c for c in rows.columns if c != id_column]
    repeated = stage(duplicate_ids(rows, id_column).select(id_column), "repeated")
    single = rows.filter(F.col(id_column).isNotNull()).join(repeated, id_column, "left_anti")
    several = rows.join(repeated, id_column, "left_semi").groupBy(id_column).agg(F.min(F.struct(*others)).alias("first"))
    first = several.select(id_column, *[F.col("first").getField(c).alias(c) for c in others])
    return single.select(*rows.columns).unionByName(first)


def absent_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct non-null ``ids(node_id)`` without a node row, staged.

    Only ids are shuffled for this. There are few as a rule, and as a file the
    planner knows it, so the edges themselves need no shuffle to be checked.
    """
    known = nodes.select("node_id")
    return stage(ids.select("node_id").dropna().distinct().join(known, "node_id", "left_anti"), "absent")


def _ends(edges: DataFrame) -> DataFrame:
    """``(edge_id, edge_type, end, node_id)`` of both ends."""
    return edges.select(
        "edge_id",
        "edge_type",
        F.inline(
            F.array(
                F.struct(F.lit("source").alias("end"), F.col("source_id").alias("node_id")),
                F.struct(F.lit("target").alias("end"), F.col("target_id").alias("node_id")),
            )
        ),
    )


def absent_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ids that edges start from or lead to, but no node has, staged; find them once per graph."""
    return absent_ids(nodes, edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")))


def dangling_counts(nodes: DataFrame, edges: DataFrame, absent: DataFrame | None = None) -> DataFrame:
    """``(edge_type, end, edges, dangling)``: how many edge ends lead to no node, zeros included.

    A caller who keeps the distinct ids without a node passes them as ``absent(node_id)``.
    """
    absent = absent_ends(nodes, edges) if absent is None else absent
    absent = absent.withColumn("missing", F.lit(True))
    return (
        _ends(edges)
        .join(absent, "node_id", "left")
        .groupBy("edge_type", "end")
        .agg(F.count("*").alias("edges"), F.count("missing").alias("dangling"))
    )


def dangling_edges(nodes: DataFrame, edges: DataFrame, absent: DataFrame | None = None) -> DataFrame:
    """``(edge_id, edge_type, end, missing_id)`` for each edge end without a node row.

    Ends are reduced to distinct ids before they meet the nodes, so a node with
    very many edges is looked up once.
    """
    ends = _ends(edges)
    absent = absent_ends(nodes, edges) if absent is None else absent
    return ends.join(absent, "node_id").select("edge_id", "edge_type", "end", F.col("node_id").alias("missing_id"))
