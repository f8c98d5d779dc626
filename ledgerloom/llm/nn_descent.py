"""Near-duplicate vectors by NN-descent: neighbours of neighbours are likely neighbours.

Every node holds a list of its nearest nodes found so far. Lists start from a few
random orderings in which similar vectors come to stand side by side. A round then
puts the neighbours of a node, in both directions, next to each other and compares
them; what is nearer than the end of a list enters it. Rounds go on until they find
no more pairs within the threshold, and an audit against all nodes has to agree. A
list full of such pairs is saturated and becomes twice as long.

Copies would saturate every list, so nodes are balls. A vector within half the
threshold angle of a centre is inside its ball; by the triangle inequality all
vectors of a ball link with each other, and none of these pairs is ever made. Balls
whose distance leaves links between them possible are neighbours to be found; they
are compared by blocks of their vectors, of which counts come back.

Search compares vectors rounded to bytes, with the error of each kept, so that a pair
is left out only if no rounding could have brought it below the threshold. Links are
decided in double precision.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import LAST, join_totals, ready
from ledgerloom.llm.graphs import components
from ledgerloom.llm.vectors import dimension, matrix, packed, unpacked
from ledgerloom.session import stage

COSINE = 0.9
# Length of a list before it is enlarged.
NEIGHBOURS = 8
# Orderings that the first lists come from, and the followers that a node is compared with in each.
ORDERINGS, FOLLOWERS = 4, 12
# Neighbours of one node that meet at once; those of a hub are dealt anew to such groups in every round.
MEETING = 24
# Rounds at most, and the recall over the audited nodes below which lists are enlarged and rounds go on.
ROUNDS, RECALL = 12, 0.98
# Nodes that are compared with all others for the audit.
AUDITED = 256
# A round of ball-making that absorbs a smaller share of the centres is the last one.
ABSORBED = 0.002
BALL_ROUNDS = 8
# Vectors of a ball that are compared at once.
BLOCK = 64
SEED = 42
# Larger than any rounding of an angle.
SLACK = 1e-7


class Graph(NamedTuple):
    """Links between vectors, without a row for each.

    ``nodes`` has ``node``, ``least`` (smallest order), ``copies`` (rows with this very vector), ``ball``
    and ``links`` (rows linked in other balls); ``links`` has linked balls ``(a, b)``; ``recall`` is the share
    of the audited neighbours that the lists had.
    """

    rows: DataFrame
    nodes: DataFrame
    links: DataFrame
    recall: float


def _signed(x: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(x, SEED), "little", signed=True)


def _units(vectors: DataFrame, d: int) -> DataFrame:
    """``order``, ``node`` (a hash of the direction; null where there is none) and ``unit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), d)
            most = np.abs(x).max(1, initial=0.0)
            fit = np.isfinite(most) & (most > 0)
            x = x[fit] / most[fit, None]
            x = x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0  # no negative zeros
            own = iter([x_.tobytes() for x_ in x])
            units = [next(own) if ok else None for ok in fit.tolist()]
            nodes = [None if u is None else _signed(u) for u in units]
            yield pa.RecordBatch.from_arrays(
                [batch.column("order"), pa.array(nodes, pa.int64()), pa.array(units, pa.binary())],
                ["order", "node", "unit"],
            )

    return vectors.mapInArrow(run, "order long, node long, unit binary")


def _planes(seed: int, d: int) -> np.ndarray:
    return np.random.default_rng([SEED, seed]).normal(size=(d, 62))


def _codes(x: np.ndarray, seed: int, bits: int = 62) -> np.ndarray:
    """The sides of random hyperplanes on which vectors lie, as numbers of ``bits`` bits."""
    sides = x @ _planes(seed, x.shape[1])[:, :bits] > 0
    return sides @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angles of unit vectors, row by row; by the chord, which is exact for small ones too."""
    return 2 * np.arcsin(np.minimum(np.linalg.norm(x - y, axis=1) / 2, 1.0))


def _inside(pairs: DataFrame, units: DataFrame, most: float, d: int) -> DataFrame:
    """Those ``(node, centre)`` whose ``angle`` is at most ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angle = _angles(unpacked(batch.column("x"), np.float64, d), unpacked(batch.column("y"), np.float64, d))
            found = pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("centre"), pa.array(angle)], ["node", "centre", "angle"]
            )
            yield found.filter(pa.array(angle <= most))

    x = units.select("node", F.col("unit").alias("x"))
    y = units.select(F.col("node").alias("centre"), F.col("unit").alias("y"))
    both = join_totals(join_totals(pairs.select("node", "centre"), x, "node"), y, "centre")
    return both.select("node", "centre", "x", "y").mapInArrow(run, "node long, centre long, angle double")


def _balls(units: DataFrame, most: float, d: int) -> DataFrame:
    """``node``, ``centre`` and their ``angle`` for all nodes, at most ``most``.

    In every round the centres that share a bucket of random hyperplanes are compared
    with the first of it, and the vectors of a ball whose centre lies within
    ``most`` of that one follow where they do too; others stand alone again.
    """
    balls = stage(units.select("node", F.col("node").alias("centre"), F.lit(0.0).alias("angle")), "balls")
    for turn in range(BALL_ROUNDS):
        centres = balls.filter("node = centre").select("node")
        n = centres.count()
        bits = min(62, max(1, math.ceil(math.log2(max(n, 2) / 4))))

        def coded(batches: Iterator[pa.RecordBatch], turn: int = turn, bits: int = bits) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = _codes(unpacked(batch.column("unit"), np.float64, d), 1000 + turn, bits)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(codes)], ["node", "bucket"])

        placed = units.join(centres, "node").select("node", "unit").mapInArrow(coded, "node long, bucket long")
        first = placed.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1")
        asked = join_totals(placed, first, "bucket").filter("node <> first")
        near = stage(_inside(asked.select("node", F.col("first").alias("centre")), units, most, d), "absorbed")
        absorbed = near.count()
        if absorbed:
            moved = near.select(F.col("node").alias("centre"), F.col("centre").alias("to"))
            told = join_totals(balls, moved, "centre", "left")
            asked = told.filter("to is not null and node <> centre").select("node", F.col("to").alias("centre"))
            follow = _inside(asked, units, most, d).unionByName(near)
            follow = follow.select("node", F.col("centre").alias("to_"), F.col("angle").alias("angle_"))
            stays = F.col("to").isNull()
            balls = stage(
                told.join(follow, "node", "left").select(
                    "node",
                    F.when(stays, F.col("centre")).otherwise(F.coalesce("to_", "node")).alias("centre"),
                    F.when(stays, F.col("angle")).otherwise(F.coalesce("angle_", F.lit(0.0))).alias("angle"),
                ),
                "balls",
            )
        if absorbed <= ABSORBED * n:
            break
    return balls


_SKETCH = "node long, sketch binary, scale float, error float"


def _sketches(units: DataFrame, d: int) -> DataFrame:
    """Unit vectors rounded to bytes, with the length of what rounding took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column("unit"), np.float64, d)
            scale = (np.abs(x).max(1, initial=0.0) / 127).astype(np.float32)
            rounded = np.rint(x / scale[:, None].astype(np.float64)).astype(np.int8)
            error = np.linalg.norm(x - rounded * scale[:, None].astype(np.float64), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    packed(rounded),
                    pa.array(scale),
                    pa.array((error + 1e-6).astype(np.float32)),
                ],
                ["node", "sketch", "scale", "error"],
            )

    return units.select("node", "unit").mapInArrow(run, _SKETCH)


def _least_angles(cosines: np.ndarray, x_error: np.ndarray, y_error: np.ndarray) -> np.ndarray:
    """The smallest angles that vectors can have whose rounded ones have these products."""
    off = x_error + y_error + x_error * y_error
    return np.arccos(np.clip(cosines + off, -1.0, 1.0))


def _rounded(batch: pa.RecordBatch | pa.Table, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounded vectors, their errors and the radii of their balls."""
    sketch = unpacked(batch.column("sketch"), np.int8, d).astype(np.float32)
    scale, error, radius = (batch.column(c).to_numpy() for c in ("scale", "error", "radius"))
    return sketch * scale[:, None], error, radius


def _joined(before: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    """What an earlier batch left, and the next one."""
    if before is None:
        return batch
    arrays = [pa.concat_arrays([x, y]) for x, y in zip(before.columns, batch.columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, batch.schema.names)


_ENTRY = "u long, v long, gap float, near boolean"


def _entries(u: np.ndarray, v: np.ndarray, gap: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(u), pa.array(v), pa.array(gap.astype(np.float32)), pa.array(near)]
    return pa.RecordBatch.from_arrays(arrays, ["u", "v", "gap", "near"])


def _first_lists(nodes: DataFrame, angle: float, d: int) -> DataFrame:
    """Entries from the neighbourhoods in random orderings."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, _ = _rounded(batch, d)
            for k in range(ORDERINGS):
                arrays = [pa.array(np.full(len(x), k, np.int32)), pa.array(_codes(x, k)), *batch.columns]
                yield pa.RecordBatch.from_arrays(arrays, ["ordering", "code", *batch.schema.names])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = _joined(before, batch)
            if not rows.num_rows:
                continue
            x, error, radius = _rounded(rows, d)
            nodes_, ordering = rows.column("node").to_numpy(), rows.column("ordering").to_numpy()
            old = 0 if before is None else before.num_rows
            for k in range(1, min(FOLLOWERS, len(x) - 1) + 1):
                a = np.arange(max(0, old - k), len(x) - k)
                a = a[ordering[a] == ordering[a + k]]
                b = a + k
                least = _least_angles(np.einsum("ij,ij->i", x[a], x[b]), error[a], error[b])
                near = least <= angle + radius[a] + radius[b]
                yield _entries(nodes_[a], nodes_[b], least - radius[b], near)
                yield _entries(nodes_[b], nodes_[a], least - radius[a], near)
            before = rows.slice(max(0, len(x) - FOLLOWERS))

    columns = f"ordering int, code long, {_SKETCH}, radius float"
    given = nodes.select("node", "sketch", "scale", "error", "radius")
    ordered = given.mapInArrow(coded, columns).repartitionByRange("ordering", "code", "node")
    return ordered.sortWithinPartitions("ordering", "code", "node").mapInArrow(compared, _ENTRY)


def _best(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """The first ``size`` entries of each list; ``fresh`` only where no old entry says the same."""
    one = entries.groupBy("u", "v").agg(
        F.min("gap").alias("gap"), F.bool_or("near").alias("near"), F.bool_and("fresh").alias("fresh")
    )
    return one.join(sizes, "u").withColumn(
        "place", F.expr("row_number() OVER (PARTITION BY u ORDER BY gap, v)")
    ).filter("place <= size").drop("place")


def _met(lists: DataFrame, nodes: DataFrame, sizes: DataFrame, turn: int, angle: float, d: int) -> DataFrame:
    """Entries found by comparing the neighbours of each node with each other."""
    both = lists.select("u", "v", "fresh").unionByName(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh"))
    both = both.groupBy("u", "v").agg(F.bool_or("fresh").alias("fresh"))
    around = both.groupBy("u").agg(F.ceil(F.count("*") / MEETING).alias("groups"))
    dealt = join_totals(both, around, "u").select(
        "u", "v", "fresh", F.pmod(F.xxhash64("u", "v", F.lit(turn)), F.col("groups")).alias("group")
    )
    ends = lists.groupBy("u").agg(F.count("*").alias("n"), F.max("gap").alias("end"))
    floors = nodes.join(ends.join(sizes, "u").withColumnRenamed("u", "node"), "node").select(
        F.col("node").alias("v"), "sketch", "scale", "error", "radius", "grown",
        F.when(F.col("n") >= F.col("size"), F.col("end")).otherwise(F.lit(10.0)).cast("float").alias("end"),
    )
    entries = join_totals(dealt, floors, "v").withColumn("fresh", F.col("fresh") | F.col("grown"))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = _joined(before, batch)
            if not rows.num_rows:
                continue
            u, group = rows.column("u").to_numpy(), rows.column("group").to_numpy()
            starts = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (group[1:] != group[:-1])])
            before = rows.slice(int(starts[-1]))
            yield from _all_pairs(rows.slice(0, int(starts[-1])), starts, angle, d)
        if before is not None:
            yield from _all_pairs(before, np.array([0, before.num_rows]), angle, d)

    columns = ["u", "group", "v", "sketch", "scale", "error", "radius", "end", "fresh"]
    together = entries.select(*columns).repartition("u", "group").sortWithinPartitions("u", "group")
    return together.mapInArrow(compared, _ENTRY)


def _all_pairs(rows: pa.RecordBatch, starts: np.ndarray, angle: float, d: int) -> Iterator[pa.RecordBatch]:
    """Entries from within the groups that begin at ``starts`` (its last number is the end)."""
    if not rows.num_rows:
        return
    x, error, radius = _rounded(rows, d)
    node, end = rows.column("v").to_numpy(), rows.column("end").to_numpy()
    fresh = rows.column("fresh").to_numpy(zero_copy_only=False)
    sizes = np.diff(starts)
    for size in np.unique(sizes[sizes > 1]).tolist():
        at = starts[:-1][sizes == size][:, None] + np.arange(size)
        cosines = x[at] @ x[at].transpose(0, 2, 1)
        a, b = np.broadcast_arrays(at[:, :, None], at[:, None, :])
        asked = (fresh[a] | fresh[b]) & (node[a] != node[b])
        a, b, cosines = a[asked], b[asked], cosines[asked]
        least = _least_angles(cosines, error[a], error[b])
        gap = least - radius[b]
        good = gap < end[a]
        a, b = a[good], b[good]
        yield _entries(node[a], node[b], gap[good], least[good] <= angle + radius[a] + radius[b])


def _audited(nodes: DataFrame, lists: DataFrame, angle: float, d: int) -> float:
    """The share of the neighbours of a bounded number of nodes, found among all nodes, that their lists have.

    Half of them are drawn from the nodes that have neighbours in their lists.
    """
    drawn = F.xxhash64("node", F.lit(SEED))
    known = lists.filter("near").select(F.col("u").alias("node")).distinct()
    some = nodes.join(known, "node").orderBy(drawn).limit(AUDITED // 2).unionByName(
        nodes.orderBy(drawn).limit(AUDITED // 2)
    )
    asked = some.select("node", "sketch", "scale", "error", "radius").distinct().toArrow()
    if not asked.num_rows:
        return 1.0
    ids = asked.column("node").to_numpy()
    x, error, radius = _rounded(asked.combine_chunks().to_batches()[0], d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, y_error, y_radius = _rounded(batch, d)
            other = batch.column("node").to_numpy()
            least = _least_angles(x @ y.T, error[:, None], y_error)
            i, j = np.nonzero((least <= angle + radius[:, None] + y_radius) & (ids[:, None] != other))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(other[j])], ["u", "v"])

    there = nodes.select("node", "sketch", "scale", "error", "radius").mapInArrow(run, "u long, v long")
    had = there.join(lists.select("u", "v", F.lit(1).alias("had")), ["u", "v"], "left")
    n, of = had.agg(F.sum("had"), F.count("*")).first()
    return (n or 0) / of if of else 1.0


def neighbour_lists(nodes: DataFrame, angle: float, d: int) -> tuple[DataFrame, float]:
    """Lists of ``nodes`` (``_SKETCH`` and ``radius``) as ``(u, v, gap, near)``, and the audited recall.

    ``near`` marks balls that may hold vectors within ``angle`` of each other.
    """
    sizes = stage(nodes.select(F.col("node").alias("u"), F.lit(NEIGHBOURS).alias("size"), F.lit(False).alias("grown")), "sizes")
    entries = _first_lists(nodes, angle, d).withColumn("fresh", F.lit(True))
    lists = stage(_best(entries, sizes.drop("grown")).drop("size"), "lists")
    found, recall = 0, 0.0
    for turn in range(ROUNDS):
        full = lists.groupBy("u").agg(F.count("*").alias("n"), F.bool_and("near").alias("all_near"))
        full = sizes.join(full, "u", "left").withColumn("grown", F.coalesce(F.expr("all_near and n >= size"), F.lit(False)))
        sizes = stage(full.select("u", F.expr("if(grown, size * 2, size)").alias("size"), "grown"), "sizes")
        met = _met(lists, nodes, sizes, turn, angle, d).withColumn("fresh", F.lit(True))
        old = lists.withColumn("fresh", F.lit(False))
        lists = stage(_best(old.unionByName(met), sizes.drop("grown")).drop("size"), "lists")
        before, found = found, lists.filter("near").count()
        if found - before > found / 1000 or not sizes.filter("grown").isEmpty():
            continue
        recall = _audited(nodes, lists, angle, d)
        if recall >= RECALL:
            break
        sizes = stage(sizes.select("u", (F.col("size") * 2).alias("size"), F.lit(True).alias("grown")), "sizes")
    else:
        recall = _audited(nodes, lists, angle, d)
    return lists, recall


def _blocks(balls: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The vectors of the balls ``asked`` for, up to about ``BLOCK`` in a row."""
    members = join_totals(balls.select("node", "centre"), asked, "centre")
    sizes = members.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = join_totals(members, sizes, "centre").join(nodes.select("node", "copies", "unit"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    return members.groupBy("centre", block).agg(F.collect_list(F.struct("node", "copies", "unit")).alias("members"))


def _exact(pairs: DataFrame, balls: DataFrame, nodes: DataFrame, cosine: float, d: int) -> DataFrame:
    """For balls ``pairs(a, b)``: ``node`` and ``n``, the rows linked with it, and one row with ``a`` and ``b`` where any are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes_, counts, a, b = [], [], [], []
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values for c in ("x", "y"))
                ux, uy = (unpacked(v.field("unit"), np.float64, d) for v in (x, y))
                linked = ux @ uy.T >= cosine
                if linked.any():
                    a.append(batch.column("a")[k].as_py())
                    b.append(batch.column("b")[k].as_py())
                    for v, n in (
                        (x, linked @ y.field("copies").to_numpy()),
                        (y, x.field("copies").to_numpy() @ linked),
                    ):
                        nodes_.append(v.field("node").to_numpy()[n > 0])
                        counts.append(n[n > 0])
            none, n = pa.nulls(len(a), pa.int64()), sum(map(len, counts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *nodes_])), none]),
                    pa.concat_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *counts])), none]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(a, pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(b, pa.int64())]),
                ],
                ["node", "n", "a", "b"],
            )

    asked = pairs.select(F.explode(F.array("a", "b")).alias("centre")).distinct()
    blocks = stage(_blocks(balls, nodes, asked), "blocks")
    x = blocks.select(F.col("centre").alias("a"), F.col("members").alias("x"))
    y = blocks.select(F.col("centre").alias("b"), F.col("members").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "node long, n long, a long, b long")


def link_graph(vectors: DataFrame, cosine: float = COSINE) -> Graph:
    """Links of ``vectors(order, vector)`` with at least this ``cosine`` (over 0)."""
    ready(vectors.sparkSession)
    d, angle = dimension(vectors, "vector"), math.acos(cosine)
    rows = stage(_units(vectors, d), "units")
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.min("order").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit")
    )
    nodes = stage(nodes, "vectors")
    units = nodes.select("node", "unit")
    balls = _balls(units, angle / 2 - SLACK, d)
    radii = balls.groupBy(F.col("centre").alias("node")).agg((F.max("angle") + SLACK).cast("float").alias("radius"))
    centres = stage(_sketches(units.join(radii, "node"), d).join(radii, "node"), "centres")
    lists, recall = neighbour_lists(centres, angle, d)
    if recall < RECALL:
        warnings.warn(f"after {ROUNDS} rounds the lists have {recall:.3f} of the audited neighbours", stacklevel=2)
    pairs = lists.filter("near").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    found = stage(_exact(pairs, balls, nodes, cosine, d), "links")
    counts = found.filter("node is not null").groupBy("node").agg(F.sum("n").alias("links"))
    told = nodes.select("node", "least", "copies").join(balls.select("node", F.col("centre").alias("ball")), "node")
    told = told.join(counts, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return Graph(rows, stage(told, "told"), found.filter("a is not null").select("a", "b").distinct(), recall)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row of ``vectors(vec_id, embedding)``.

    Two rows link if the cosine of their vectors, in double precision, is at least
    ``cosine``. ``n_links`` counts the other rows linked with a row, ``component_id`` is the
    smallest ``vec_id`` reachable over links, ``kept`` says whether that is the row's own.

    A null vector, one of zeros only, and one with a null or non-finite component link
    with nothing and stay. A vector shorter than others counts as if filled with
    zeros. Each of several rows with one ``vec_id`` is a row of its own; they aren't
    linked by the id alone. A null ``vec_id`` counts as the largest, and a component without
    any id has a null one, whose rows all stay. No rows give none; other columns are
    ignored, whatever their names.
    """
    order = F.coalesce(vectors["vec_id"].cast("long"), F.lit(LAST)).alias("order")
    rows, nodes, links, _ = link_graph(vectors.select(order, vectors["embedding"].alias("vector")), cosine)
    reached = components(links).select(F.col("node").alias("ball"), F.col("component").alias("group"))
    sizes = nodes.groupBy("ball").agg(F.sum("copies").alias("size"), F.min("least").alias("least"))
    sizes = sizes.join(reached, "ball", "left").withColumn("group", F.coalesce("group", "ball"))
    least = sizes.groupBy("group").agg(F.min("least").alias("component"))
    sizes = join_totals(sizes.select("ball", "size", "group"), least, "group").select("ball", "size", "component")
    told = join_totals(nodes.select("node", "ball", "links"), sizes, "ball")
    told = told.select("node", (F.col("size") - 1 + F.col("links")).alias("n_links"), "component")
    known = join_totals(rows.filter("node is not null").select("order", "node"), told, "node")
    alone = rows.filter("node is null").select("order", F.lit(0).cast("long").alias("n_links"), F.col("order").alias("component"))

    def public(order: str):
        return F.when(F.col(order) != LAST, F.col(order))

    return known.select("order", "n_links", "component").unionByName(alone).select(
        public("order").alias("vec_id"),
        "n_links",
        public("component").alias("component_id"),
        (F.col("order") == F.col("component")).alias("kept"),
    )
