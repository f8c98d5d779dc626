"""Lookups, neighbourhoods, subgraphs, pages and paths over nodes and edges.

Every operator answers a whole table of seeds at once. An edge meets its two
ends by exploding it, so each hop is one equi-join instead of an OR condition.
Results that may be large per seed are rows, never collected lists.

Where every node is asked for, what matters is which ends of edges have no node.
These ids are few and the same for every query, so a caller who keeps them passes
them as ``absent(node_id)`` (``graph_checks.absent_ends``, or what a stored graph has);
otherwise they are looked up.

A caller who knows the types of the chosen nodes names them as ``types``. Which types an edge
connects follows from its own type (``EDGE_ENDS``), so only edges that can be at such nodes
are read, and only from the ends that can be them.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.graph_build import EDGE_COLUMNS, EDGE_ENDS, NODE_COLUMNS
from ledgerloom.operators.graph_checks import absent_ends
from ledgerloom.session import stage
from ledgerloom.sources.graph_store import StoredGraph, few_ids

SAMPLE_SIZE = 5
PAGE_SIZE = 500
MAX_PAGE_SIZE = 1000
# Rows that a hub makes in one task; beyond, its edges are dealt to several.
PART_ROWS = 1 << 20
# Numbers of paths grow as products of degrees.
_WAYS = "decimal(38,0)"


def lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes whose id is in ``ids(node_id)``; see :func:`stored_lookup` for a stored graph."""
    return nodes.join(ids.select("node_id"), "node_id", "left_semi").select(*NODE_COLUMNS)


def _of_types(nodes: DataFrame, types: Collection[str] | None) -> DataFrame:
    return nodes if types is None else nodes.filter(F.col("node_type").isin(*sorted(types)))


def _next_types(types: Collection[str] | None) -> set[str] | None:
    """Types one hop away from nodes of ``types``."""
    if types is None:
        return None
    pairs = [pair for ends in EDGE_ENDS.values() for pair in (ends, ends[::-1])]
    return {far for near, far in pairs if near in types}


def _ends_of(types: Collection[str], end: int) -> Column:
    """Whether the source (0) or target (1) of an edge is a node of ``types``."""
    return F.col("edge_type").isin(*[name for name, ends in EDGE_ENDS.items() if ends[end] in types])


def _touching(edges: DataFrame, types: Collection[str] | None) -> DataFrame:
    """Edges that have an end of ``types``; prunes folders."""
    return edges if types is None else edges.filter(_ends_of(types, 0) | _ends_of(types, 1))


def links(edges: DataFrame, types: Collection[str], depth: int) -> DataFrame:
    """``edge_type`` and ends of the edges that :func:`subgraph_nodes` follows from nodes of ``types``.

    It reads them up to twice a hop: who has no files of the edges stages these short rows.
    """
    return _touching(edges, _types_within(types, depth - 1)).select("edge_type", "source_id", "target_id")


def around(nodes: DataFrame, edges: DataFrame, types: Collection[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that can be at nodes of ``types`` or one hop from them."""
    return _of_types(nodes, _types_within(types, 1)), _touching(edges, types)


def _chosen(nodes: DataFrame, ids: DataFrame, types: Collection[str] | None = None) -> DataFrame:
    """``node_id`` of the nodes in ``ids(node_id)``, staged.

    As a file its true size is known to the planner, so a few ids are sent to
    the edges instead of shuffling the edges to them.
    """
    nodes = _of_types(nodes, types)
    return stage(nodes.select("node_id").join(ids.select("node_id"), "node_id", "left_semi"), "chosen")


def _at_nodes(
    rows: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    ids: DataFrame | None,
    absent: DataFrame | None,
    types: Collection[str] | None = None,
) -> DataFrame:
    """``rows`` whose ``node_id`` is one of the chosen nodes, or any node."""
    if ids is not None:
        return rows.join(_chosen(nodes, ids, types), "node_id", "left_semi")
    absent = absent_ends(nodes, edges) if absent is None else absent
    return rows.filter(F.col("node_id").isNotNull()).join(absent.select("node_id"), "node_id", "left_anti")


def incident_edges(
    nodes: DataFrame,
    edges: DataFrame,
    ids: DataFrame | None = None,
    absent: DataFrame | None = None,
    types: Collection[str] | None = None,
) -> DataFrame:
    """Edges of each node, as ``outgoing`` from and ``incoming`` to it.

    A self-loop shows up in both directions. ``ids`` limits the nodes, all of which are of
    ``types`` if these are given; without ``ids`` every node is answered.
    """
    sides = [
        F.struct(
            F.col("source_id").alias("node_id"),
            F.lit("outgoing").alias("direction"),
            F.col("target_id").alias("neighbor_id"),
        ),
        F.struct(
            F.col("target_id").alias("node_id"),
            F.lit("incoming").alias("direction"),
            F.col("source_id").alias("neighbor_id"),
        ),
    ]
    if types is not None:
        sides = [F.when(_ends_of(types, end), side) for end, side in enumerate(sides)]
    directed = _touching(edges, types).select(*EDGE_COLUMNS, F.inline(F.array_compact(F.array(*sides))))
    found = _at_nodes(directed, nodes, edges, ids, absent, types)
    return found.select("node_id", "direction", "neighbor_id", *EDGE_COLUMNS)


def neighbors(
    nodes: DataFrame,
    edges: DataFrame,
    ids: DataFrame | None = None,
    absent: DataFrame | None = None,
    types: Collection[str] | None = None,
    about: DataFrame | None = None,
) -> DataFrame:
    """Distinct neighbours of each node that have a node row themselves.

    Further columns by ``node_id`` can go ``about`` each node, null where there are none; they
    meet the pairs of ids, before texts make these wide.
    """
    return _with_nodes(_of_types(nodes, _next_types(types)), incident_edges(nodes, edges, ids, absent, types), about)


def _with_nodes(nodes: DataFrame, incident: DataFrame, about: DataFrame | None = None) -> DataFrame:
    pairs = incident.select("node_id", "neighbor_id").distinct()
    more = [] if about is None else [c for c in about.columns if c != "node_id"]
    if about is not None:
        pairs = pairs.join(about, "node_id", "left")
    others = nodes.select(
        F.col("node_id").alias("neighbor_id"),
        F.col("node_type").alias("neighbor_type"),
        F.col("label").alias("neighbor_label"),
        F.col("metadata_json").alias("neighbor_metadata"),
    )
    return pairs.join(others, "neighbor_id").select(
        "node_id", "neighbor_id", "neighbor_type", "neighbor_label", "neighbor_metadata", *more
    )


def related_counts(
    nodes: DataFrame,
    edges: DataFrame,
    ids: DataFrame | None = None,
    absent: DataFrame | None = None,
    types: Collection[str] | None = None,
    single: bool = False,
) -> DataFrame:
    """Number of distinct neighbours per node and neighbour type.

    The type of a neighbour follows from the edge type and the direction, so the
    pairs needn't meet the nodes: edges with an end that has no node go first, and what
    is left has nodes on both sides. ``single`` edges, as for :func:`subgraph_nodes`, are counted as they
    are, with no pairs shuffled to be distinct.
    """
    absent = absent_ends(nodes, edges) if absent is None else absent
    known = _touching(edges, types).filter("source_id is not null and target_id is not null")
    for end in ("source_id", "target_id"):
        known = known.join(absent.select(F.col("node_id").alias(end)), end, "left_anti")
    sides = [F.create_map(*[F.lit(x) for name, ends in EDGE_ENDS.items() for x in (name, ends[k])]) for k in (0, 1)]

    def side(own: str, other: str, types: Column) -> Column:
        related = types[F.col("edge_type")].alias("related_type")
        return F.struct(F.col(own).alias("node_id"), F.col(other).alias("neighbor_id"), related)

    both = F.array(side("source_id", "target_id", sides[1]), side("target_id", "source_id", sides[0]))
    pairs = known.select(F.inline(both))
    if ids is not None:
        pairs = pairs.join(_chosen(nodes, ids, types), "node_id", "left_semi")
    pairs = pairs if single else pairs.distinct()
    return pairs.groupBy("node_id", "related_type").agg(F.count("*").alias("related"))


def _adjacency(edges: DataFrame, *columns: str, types: Collection[str] | None = None) -> DataFrame:
    """Each edge at each of its ends, or at those that are of ``types``."""
    if types is None:
        ends = F.array_distinct(F.array("source_id", "target_id"))
    else:
        own = [F.when(_ends_of(types, end), F.col(c)) for end, c in enumerate(("source_id", "target_id"))]
        ends = F.array_distinct(F.array_compact(F.array(*own)))
    return _touching(edges, types).select(F.explode(ends).alias("node_id"), "source_id", "target_id", *columns)


def _other_end() -> Column:
    return F.when(F.col("source_id") == F.col("node_id"), F.col("target_id")).otherwise(F.col("source_id"))


def hop_sizes(edges: DataFrame, frontier: DataFrame, types: Collection[str] | None = None) -> DataFrame:
    """``node_id``, ``seeds`` that have reached it, ``degree``, and ``rows``, what one more hop makes of them.

    ``frontier`` has ``seed_id`` and ``node_id``. Degrees are counted for its nodes only.
    """
    seeds = stage(frontier.groupBy("node_id").agg(F.count("*").alias("seeds")), "frontier")
    degrees = _adjacency(edges, types=types).join(seeds.select("node_id"), "node_id", "left_semi")
    degrees = degrees.groupBy("node_id").agg(F.count("*").alias("degree"))
    return seeds.join(degrees, "node_id").withColumn("rows", F.col("seeds") * F.col("degree"))


def _step(
    edges: DataFrame, frontier: DataFrame, most_rows: int | None, types: Collection[str] | None = None
) -> DataFrame:
    """``(seed_id, node_id)`` one hop on from ``frontier``.

    What a hub makes is the product of the seeds that reach it and its edges, however
    small either side is. Its edges are dealt to parts, which each seed meets one
    by one, so no task makes more than about ``PART_ROWS`` rows of one hub.
    """
    sizes = stage(hop_sizes(edges, frontier, types), "hop-sizes")
    rows, largest = sizes.agg(F.sum("rows"), F.max("rows")).first()
    if most_rows is not None and (rows or 0) > most_rows:
        raise ValueError(f"the next hop makes {rows} rows, more than {most_rows}")
    ends = _adjacency(edges, types=types)
    if (largest or 0) <= PART_ROWS:
        return frontier.join(ends, "node_id").select("seed_id", _other_end().alias("node_id"))
    parts = F.ceil(F.col("rows") / PART_ROWS).alias("parts")
    hubs = stage(sizes.filter(F.col("rows") > PART_ROWS).select("node_id", parts), "hubs")
    light = frontier.join(hubs, "node_id", "left_anti").join(ends, "node_id")
    part = F.pmod(F.xxhash64("source_id", "target_id"), F.col("parts"))
    dealt = ends.join(hubs, "node_id").withColumn("part", part).drop("parts")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    heavy = frontier.join(hubs, "node_id").select("seed_id", "node_id", each).join(dealt, ["node_id", "part"])
    return light.select("seed_id", _other_end().alias("node_id")).unionByName(
        heavy.select("seed_id", _other_end().alias("node_id"))
    )


def _reached(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: DataFrame,
    depth: int,
    most_rows: int | None = None,
    types: Collection[str] | None = None,
) -> DataFrame:
    """``(seed_id, node_id)`` of all ids within ``depth`` hops, the seed included.

    Ids without a node row are reached and passed through like any other. What is
    reached is staged after each hop, so its true size decides how the next join runs.
    """
    start = _chosen(nodes, seeds.select(F.col("seed_id").alias("node_id")), types)
    beyond: set[str] | None = None  # types of what was reached besides the seeds
    reached = start.select(F.col("node_id").alias("seed_id"), "node_id")
    for hop in range(1, depth + 1):
        if hop == 1:  # every seed meets its own edges once
            ends = _adjacency(edges, types=types)
            step = reached.join(ends, "node_id").select("seed_id", _other_end().alias("node_id"))
            beyond = _next_types(types)
        else:
            step = _step(edges, reached.filter(F.col("node_id") != F.col("seed_id")), most_rows, beyond)
            beyond = None if beyond is None else beyond | _next_types(beyond)
        reached = stage(reached.unionByName(step).distinct(), "reached")
    return reached


def subgraph_nodes(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: DataFrame | None,
    depth: int = 2,
    absent: DataFrame | None = None,
    most_rows: int | None = None,
    types: Collection[str] | None = None,
    single: bool = False,
) -> DataFrame:
    """Nodes within ``depth`` undirected hops (1 or more) of each ``seeds(seed_id)``.

    A seed that is no node has an empty subgraph. Without ``seeds`` every node
    is one, at depth 1 only: beyond, all neighbours of a hub would be related to
    each other. A hop that would make more than ``most_rows`` rows, by the degrees of
    what is reached, is refused with an error before it is made. Who knows that the edges
    link no two ids twice and no id to itself (``graph_build.build_links``) says ``single``,
    and from all nodes nothing is shuffled to be distinct.
    """
    _check_depth(depth, seeds)
    if seeds is None:
        return _all_neighborhoods(nodes, edges, absent, single)
    reached = _reached(nodes, edges, seeds, depth, most_rows, types)
    return reached.join(_of_types(nodes, _types_within(types, depth)), "node_id").select("seed_id", *NODE_COLUMNS)


def _all_neighborhoods(nodes: DataFrame, edges: DataFrame, absent: DataFrame | None, single: bool) -> DataFrame:
    """Each node and what is one hop from it: the edges themselves, and the node, which need meet no other rows."""
    step = _at_nodes(_adjacency(edges), nodes, edges, None, absent)
    step = step.select(F.col("node_id").alias("seed_id"), _other_end().alias("node_id"))
    if not single:
        step = step.filter(F.col("seed_id") != F.col("node_id")).distinct()
    own = nodes.filter(F.col("node_id").isNotNull()).select(F.col("node_id").alias("seed_id"), *NODE_COLUMNS)
    return step.join(nodes, "node_id").select("seed_id", *NODE_COLUMNS).unionByName(own)


def _types_within(types: Collection[str] | None, depth: int) -> set[str] | None:
    """Types that nodes within ``depth`` hops of nodes of ``types`` have."""
    if types is None:
        return None
    within = set(types)
    for _ in range(depth):
        within |= _next_types(within)
    return within


def subgraph_edges(
    nodes: DataFrame,
    edges: DataFrame,
    seeds: DataFrame | None,
    depth: int = 2,
    absent: DataFrame | None = None,
    types: Collection[str] | None = None,
) -> DataFrame:
    """Edges with at least one end closer than ``depth`` hops to the seed.

    A seed meets an edge twice where it has come to both ends. With ``types`` these can only
    be edges between two of the types within reach; of others all rows with an id are
    taken to differ, as built edges do, and aren't compared.
    """
    _check_depth(depth, seeds)
    within = _types_within(types, depth - 1)
    ends = _adjacency(edges, "edge_id", "edge_type", "metadata_json", types=within)
    if depth == 1:
        # Each edge is at each of its ends once, so nothing repeats.
        ids = None if seeds is None else seeds.select(F.col("seed_id").alias("node_id"))
        found = _at_nodes(ends, nodes, edges, ids, absent, types)
        return found.select(F.col("node_id").alias("seed_id"), *EDGE_COLUMNS)
    reached = _reached(nodes, edges, seeds, depth - 1, types=types)
    if within is None:
        return reached.join(ends, "node_id").select("seed_id", *EDGE_COLUMNS).distinct()
    twice = (_ends_of(within, 0) & _ends_of(within, 1)) | F.col("edge_id").isNull()
    found = [reached.join(ends.filter(kind), "node_id").select("seed_id", *EDGE_COLUMNS) for kind in (twice, ~twice)]
    return found[0].distinct().unionByName(found[1])


def _check_depth(depth: int, seeds: DataFrame | None) -> None:
    if depth < 1:
        raise ValueError("depth must be at least 1")
    if depth > 1 and seeds is None:
        raise ValueError("name the seeds of subgraphs deeper than 1")


def type_counts(rows: DataFrame, type_column: str) -> DataFrame:
    """Rows per type; sort by count, descending, for a report."""
    return rows.groupBy(type_column).agg(F.count("*").alias("count"))


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, type, count)`` of nodes and edges with a TOTAL row per kind."""

    def totals(rows: DataFrame, kind: str, column: str) -> DataFrame:
        return (
            type_counts(rows, column)  # a rollup of the rows themselves would pass each one on twice
            .rollup(column)
            .agg(F.grouping(column).alias("is_total"), F.sum("count").alias("count"))
            .select(
                F.lit(kind).alias("kind"),
                F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col(column)).alias("type"),
                "count",
            )
        )

    return totals(nodes, "node", "node_type").unionByName(totals(edges, "edge", "edge_type"))


def sample_nodes(nodes: DataFrame, limit: int = SAMPLE_SIZE) -> DataFrame:
    return nodes.select(*NODE_COLUMNS).orderBy("node_type", "node_id").limit(limit)


def sample_edges(edges: DataFrame, limit: int = SAMPLE_SIZE) -> DataFrame:
    return edges.select(*EDGE_COLUMNS).orderBy("edge_type", "edge_id").limit(limit)


def merge(batches: Sequence[DataFrame], id_column: str) -> DataFrame:
    """Union of ``batches`` with one row per id, taken from the last batch that has it.

    ``batch`` numbers the batch a row came from.
    """
    merged = None
    for number, rows in enumerate(batches):
        others = [c for c in rows.columns if c != id_column]
        tagged = rows.select(id_column, F.struct(F.lit(number).alias("batch"), *others).alias("row"))
        merged = tagged if merged is None else merged.unionByName(tagged)
    if merged is None:
        raise ValueError("no batches")
    latest = merged.groupBy(id_column).agg(F.max("row").alias("row"))
    return latest.select(id_column, "row.*")


def highlight(rows: DataFrame, id_column: str, referenced: DataFrame) -> DataFrame:
    """``rows`` with a flag telling whether the id is in ``referenced(ref_id)``."""
    marks = referenced.select(F.col("ref_id").alias(id_column), F.lit(True).alias("marked")).distinct()
    return rows.join(marks, id_column, "left").select(
        *rows.columns, F.coalesce("marked", F.lit(False)).alias("highlighted")
    )


def _check_limit(limit: int) -> None:
    if not 1 <= limit <= MAX_PAGE_SIZE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE_SIZE}")


def _page(rows: DataFrame, key: str, limit: int, after_id: str | None) -> DataFrame:
    """The first ``limit`` rows behind ``after_id``: however deep a page is, a task keeps ``limit`` rows."""
    _check_limit(limit)
    total = rows.agg(F.count("*").alias("total"))
    left = rows if after_id is None else rows.filter(F.col(key) > after_id)
    return left.orderBy(key).limit(limit).withColumn("total", total.scalar())


def node_page(
    nodes: DataFrame, node_type: str | None = None, limit: int = PAGE_SIZE, after_id: str | None = None
) -> DataFrame:
    """One page of nodes by id, each row with the total number of matches.

    ``after_id`` is the last id of the page before; without it this is the first page.
    """
    rows = nodes if node_type is None else nodes.filter(F.col("node_type") == node_type)
    return _page(rows.select(*NODE_COLUMNS), "node_id", limit, after_id)


def stored_lookup(stored: StoredGraph, ids: DataFrame) -> DataFrame:
    """:func:`lookup` in a stored graph; a few ids read only the files that can hold them."""
    few = few_ids(ids, "node_id")
    return lookup(stored.nodes, ids) if few is None else stored.having("nodes", "node_id", few)


def stored_incident_edges(stored: StoredGraph, ids: DataFrame) -> DataFrame:
    """:func:`incident_edges` of chosen nodes in a stored graph; a few ids read only the files that can hold them."""
    few = few_ids(ids, "node_id")
    if few is None:
        return incident_edges(*stored, ids)
    ends = [stored.having("edges", end, few) for end in ("source_id", "target_id")]
    found = ends[0].unionByName(ends[1].filter(~F.coalesce(F.col("source_id").isin(few), F.lit(False))))
    return incident_edges(stored.having("nodes", "node_id", few), found, ids)


def stored_neighbors(stored: StoredGraph, ids: DataFrame) -> DataFrame:
    """:func:`neighbors` of chosen nodes in a stored graph."""
    return _with_nodes(stored.nodes, stored_incident_edges(stored, ids))


def stored_node_page(
    stored: StoredGraph, node_type: str | None = None, limit: int = PAGE_SIZE, after_id: str | None = None
) -> DataFrame:
    """:func:`node_page` of a stored graph: reads the files the page lies in, the total is stored."""
    _check_limit(limit)
    rows, total = stored.page("nodes", limit, after_id, None if node_type is None else [node_type])
    return rows.withColumn("total", F.lit(total).cast("bigint"))


def stored_edge_page(
    stored: StoredGraph, limit: int = PAGE_SIZE, after_id: str | None = None, source_id: str | None = None, **types: str | None
) -> DataFrame:
    """:func:`edge_page` of a stored graph; with a ``source_id`` it reads the files with edges of that node."""
    _check_limit(limit)
    wanted = _edge_types(**types)
    if source_id is not None:
        rows = stored.having("edges", "source_id", [source_id]).filter(F.col("edge_type").isin(wanted))
        return _page(rows, "edge_id", limit, after_id)
    rows, total = stored.page("edges", limit, after_id, wanted)
    return rows.withColumn("total", F.lit(total).cast("bigint"))


def _edge_types(
    source_type: str | None = None, target_type: str | None = None, edge_type: str | None = None
) -> list[str]:
    """Edge types that fit; the types of the ends follow from the edge type."""
    if edge_type is not None and edge_type not in EDGE_ENDS:
        raise ValueError(f"edge_type must be one of {', '.join(EDGE_ENDS)}")
    return [
        name
        for name, (source, target) in EDGE_ENDS.items()
        if edge_type in (None, name) and source_type in (None, source) and target_type in (None, target)
    ]


def filter_edges(
    edges: DataFrame,
    source_type: str | None = None,
    source_id: str | None = None,
    target_type: str | None = None,
    edge_type: str | None = None,
) -> DataFrame:
    """Edges by type and ends. End types follow from the edge type, so this prunes folders."""
    rows = edges.filter(F.col("edge_type").isin(_edge_types(source_type, target_type, edge_type)))
    return rows if source_id is None else rows.filter(F.col("source_id") == source_id)


def edge_page(
    edges: DataFrame, limit: int = PAGE_SIZE, after_id: str | None = None, **filters: str | None
) -> DataFrame:
    """One page of edges by id; see :func:`node_page`, and :func:`filter_edges` for the filters."""
    return _page(filter_edges(edges, **filters).select(*EDGE_COLUMNS), "edge_id", limit, after_id)


def _hops(edges: DataFrame, edge_types: Sequence[str]) -> list[DataFrame]:
    """For each step its edges as ``node_k`` and ``node_k+1``, along the edge or against it, whichever continues the path."""
    if not edge_types:
        raise ValueError("no edge types")
    hops, at = [], _start_type(edge_types)
    for step, edge_type in enumerate(edge_types):
        source, target = EDGE_ENDS[edge_type]
        if at not in (source, target):
            raise ValueError(f"{edge_type} does not start at {at}")
        near, far = ("source_id", "target_id") if at == source else ("target_id", "source_id")
        rows = edges.filter(F.col("edge_type") == edge_type)
        hops.append(rows.select(F.col(near).alias(f"node_{step}"), F.col(far).alias(f"node_{step + 1}")))
        at = target if at == source else source
    return hops


def _onwards(hops: list[DataFrame]) -> list[DataFrame]:
    """For each step its node and ``onwards``, the number of ways from there to the end of the path, staged.

    Summed from the end backwards, so a node with any number of paths is one row at
    every step; a dead end has none.
    """
    found: list[DataFrame] = []
    for hop in reversed(hops):
        near, far = hop.columns
        hop = hop.join(found[0], far) if found else hop.withColumn("onwards", F.lit(1))
        ways = hop.groupBy(near).agg(F.sum(F.col("onwards").cast(_WAYS)).cast(_WAYS).alias("onwards"))
        found.insert(0, stage(ways, "onwards"))
    return found


def typed_path(nodes: DataFrame, edges: DataFrame, edge_types: Sequence[str]) -> DataFrame:
    """All paths that follow ``edge_types`` in order, as columns ``node_0`` to ``node_n``.

    Each step goes along the edge or against it, whichever continues the path. The
    first node must exist. Edges that lead to where a path can't be finished are left
    out before any path is written, so no row made on the way is lost later on.
    """
    hops = _hops(edges, edge_types)
    paths = _path_starts(nodes, edge_types)
    alive = _onwards(hops[1:])
    for step, hop in enumerate(hops):
        if step < len(alive):
            # What ends in nothing is known by its far end, of which there are fewer than edges.
            hop = hop.join(alive[step].select(hop.columns[1]), hop.columns[1], "left_semi")
        paths = paths.join(hop, f"node_{step}")
    return paths.select(*[f"node_{i}" for i in range(len(hops) + 1)])


def path_counts(nodes: DataFrame, edges: DataFrame, edge_types: Sequence[str]) -> DataFrame:
    """How many of the paths of :func:`typed_path` visit each node, as ``step``, ``node_id`` and ``paths``; none is listed.

    Ways from the start are summed forwards and ways to the end backwards, and their
    product counts the paths through a node. The counts of each step add up to the
    number of all paths.
    """
    hops = _hops(edges, edge_types)
    onwards = _onwards(hops)
    reached = _path_starts(nodes, edge_types).groupBy("node_0").agg(F.count("*").cast(_WAYS).alias("ways"))
    found = []
    for step in range(len(hops) + 1):
        node = f"node_{step}"
        last = step == len(hops)
        reached = reached.withColumn("onwards", F.lit(1).cast(_WAYS)) if last else reached.join(onwards[step], node)
        reached = stage(reached, "reached")
        paths = (F.col("ways") * F.col("onwards")).cast(_WAYS).alias("paths")
        found.append(reached.select(F.lit(step).alias("step"), F.col(node).alias("node_id"), paths))
        if not last:
            ways = hops[step].join(reached.select(node, "ways"), node).groupBy(f"node_{step + 1}")
            reached = ways.agg(F.sum("ways").cast(_WAYS).alias("ways"))
    return reduce(DataFrame.unionByName, found)


def _path_starts(nodes: DataFrame, edge_types: Sequence[str]) -> DataFrame:
    start = nodes.filter(F.col("node_type") == _start_type(edge_types))
    return start.select(F.col("node_id").alias("node_0"))


def _start_type(edge_types: Sequence[str]) -> str:
    source, target = EDGE_ENDS[edge_types[0]]
    if len(edge_types) > 1 and target not in EDGE_ENDS[edge_types[1]] and source in EDGE_ENDS[edge_types[1]]:
        return target
    return source
