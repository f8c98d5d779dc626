"""Hard negatives by a multiway hyperplane tree with distance ranges.

A score is the inner product of two vectors. With one more component that brings
every row to the same length, rows with higher scores are nearer to an anchor, and a
window of scores is an annulus around it. At each node of the tree a few split
points divide the rows by which of them is nearest; for each split point and each
sibling subtree the node stores the least and the greatest distance between them. By
the triangle inequality these bound the distances of an anchor to a whole subtree,
and a subtree whose bounds miss all annuli of the anchor is eliminated.

The tree is made from a bounded sample, but all rows are in its leaves and in its
ranges. An anchor first visits the leaves next to it. What it finds there narrows its
annuli, and then it visits all other leaves that are left, so results are exact.
Anchors and rows meet in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.frames import join_totals, ready
from ledgerloom.llm.vectors import dimension, matrix, packed, unpacked
from ledgerloom.session import stage

POSITIVES, NEGATIVES = 5, 10
# Scores of negatives lie within these shares of the positive's, in per cent.
WINDOW = (30, 90)
# Subtrees of a node, levels at most (so 4096 leaves), and rows per leaf that are aimed at.
FANOUT, DEPTH, LEAF = 16, 3, 256
# Rows that the split points are chosen from.
SAMPLE = 16_384
# The share of the leaves that an anchor visits first.
FIRST = 1 / 16
# Rows and anchors that meet at once, and the buckets of adjacent leaves that anchors are sent to.
ROWS, ANCHORS, BUCKETS = 256, 64, 128
SEED = 42
LOWEST, HIGHEST = -(1 << 62), 1 << 62


class Tree(NamedTuple):
    """Split points, and distances from each of them (second index) to each sibling subtree (third), by level and node."""

    points: list[np.ndarray]
    lows: list[np.ndarray]
    highs: list[np.ndarray]

    def descend(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level the nodes that the rows of ``x`` are at, their distances to its split points and the nearest one."""
        node = np.zeros(len(x), np.int64)
        for points in self.points:
            distances = np.linalg.norm(x[:, None] - points[node], axis=2)
            child = distances.argmin(1)
            yield node, distances, child
            node = node * points.shape[1] + child

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for node_, _, child in self.descend(x):
            node = node_ * self.points[0].shape[1] + child
        return node

    @property
    def width(self) -> int:
        """How many adjacent leaves make a bucket."""
        return max(1, len(self.points[-1]) * self.points[-1].shape[1] // BUCKETS)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest distances of each of ``q`` to the rows of each leaf, and those to its split point."""
        least, most = np.zeros((len(q), 1)), np.full((len(q), 1), np.inf)
        for points, lows, highs in zip(self.points, self.lows, self.highs, strict=True):
            m = points.shape[1]
            flat = points.reshape(-1, points.shape[2])
            distances = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (flat * flat).sum(1) - 2 * q @ flat.T, 0))
            least, most = np.repeat(least, m, 1), np.repeat(most, m, 1)
            for node in range(len(points)):
                own = slice(node * m, node * m + m)
                d = distances[:, own, None]
                least[:, own] = np.maximum(least[:, own], np.maximum(lows[node] - d, d - highs[node]).max(1))
                most[:, own] = np.minimum(most[:, own], (d + highs[node]).min(1))
        return least, most, distances


def _nearest(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Which of a node's split points each row is next to; a few rows at a time, as all differences take much memory."""
    near = np.zeros(len(rows), np.int64)
    for at in range(0, len(rows), ROWS):
        near[at : at + ROWS] = np.linalg.norm(rows[at : at + ROWS, None] - points, axis=2).argmin(1)
    return near


def _grow(sample: np.ndarray, depth: int) -> list[np.ndarray]:
    """Split points of all nodes: at each the ones of a few random rows that are farthest apart."""
    pick, levels = np.random.default_rng(SEED), []
    parts = [sample]
    for _ in range(depth):
        level, below = np.zeros((len(parts), FANOUT, sample.shape[1])), []
        for node, part in enumerate(parts):
            some = part[pick.permutation(len(part))[: 3 * FANOUT]]
            if len(some):
                apart, at = np.full(len(some), np.inf), 0
                for k in range(FANOUT):
                    level[node, k] = some[at]
                    apart = np.minimum(apart, np.linalg.norm(some - some[at], axis=1))
                    at = int(apart.argmax())
            nearest = _nearest(part, level[node])
            below += [part[nearest == k] for k in range(FANOUT)]
        levels.append(level)
        parts = below
    return levels


class _Space(NamedTuple):
    """How vectors are stored, and the length that all rows are brought to."""

    d: int
    kind: type
    exact: bool  # products can be summed in double precision
    square: float

    def numbers(self, column: pa.Array) -> np.ndarray:
        return unpacked(column, self.kind, self.d).astype(np.float64 if self.exact else np.int64)

    def rows(self, column: pa.Array) -> np.ndarray:
        """Vectors of rows, with the component that makes them equally long."""
        x = unpacked(column, self.kind, self.d).astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.square - (x * x).sum(1), 0))]

    def anchors(self, column: pa.Array) -> np.ndarray:
        x = unpacked(column, self.kind, self.d).astype(np.float64)
        return np.c_[x, np.zeros(len(x))]

    def reach(self, q: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distances at which rows have these scores (a column for each)."""
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.square - 2 * scores, 0))

    @property
    def slack(self) -> float:
        """Larger than any rounding of a distance."""
        return 1e-6 * math.sqrt(self.square) + 1e-12


def _space(rows: DataFrame) -> _Space:
    d = dimension(rows, "vector")
    low, high = F.array_min("vector"), F.array_max("vector")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most, square = rows.agg(F.max(F.greatest(-low.cast("double"), high.cast("double"))), F.max(square)).first()
    most, square = most or 0.0, square or 0.0
    if square >= 1 << 56:  # a hundred times a score has to fit, too
        raise ValueError("scores of these vectors do not fit 64 bits")
    kind = next(t for t in (np.int16, np.int32, np.int64) if t is np.int64 or most <= np.iinfo(t).max)
    return _Space(d, kind, square < 1 << 52, square * (1 + 1e-12))


def _stored(rows: DataFrame, space: _Space) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            if space.exact:
                x = matrix(lists, space.d)
            else:
                x = np.zeros((len(lists), space.d), np.int64)
                for row, values in zip(x, lists.to_pylist(), strict=True):
                    row[: len(values)] = values
            arrays = [batch.column(c) for c in ("id", "label", "anchor")]
            yield pa.RecordBatch.from_arrays([*arrays, packed(x.astype(space.kind))], ["id", "label", "anchor", "vector"])

    schema = "id long, label long, anchor boolean, vector binary"
    return rows.select("id", "label", "anchor", "vector").mapInArrow(run, schema)


def _planted(rows: DataFrame, space: _Space) -> tuple[DataFrame, Tree]:
    """``rows`` with their ``leaf``, and the tree."""
    n = rows.count()
    depth = min(DEPTH, max(1, round(math.log(max(n / LEAF, 1), FANOUT))))
    drawn = rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").select("vector").limit(SAMPLE).toArrow()
    points = _grow(space.rows(drawn.column("vector")), depth)
    grown = Tree(points, [], [])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = grown.leaves(space.rows(batch.column("vector")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = [(len(p), FANOUT, FANOUT) for p in points]
        low, high = [np.full(s, np.inf) for s in shapes], [np.full(s, -np.inf) for s in shapes]
        for batch in batches:
            for level, (node, distances, child) in enumerate(grown.descend(space.rows(batch.column("vector")))):
                np.minimum.at(low[level], (node, child), distances)
                np.maximum.at(high[level], (node, child), distances)
        for level in range(depth):
            for node, child in np.argwhere(high[level].max(2) >= 0).tolist():
                arrays = [[level] * FANOUT, [node] * FANOUT, [child] * FANOUT, list(range(FANOUT))]
                found = [*map(pa.array, arrays), pa.array(low[level][node, child]), pa.array(high[level][node, child])]
                yield pa.RecordBatch.from_arrays(found, ["level", "node", "child", "point", "low", "high"])

    placed = stage(rows.mapInArrow(assigned, "id long, label long, anchor boolean, vector binary, leaf long"), "leaves")
    told = placed.select("vector").mapInArrow(ranges, "level long, node long, child long, point long, low double, high double")
    told = told.groupBy("level", "node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    # One row for each pair of siblings: at most 16 times the subtrees of the tree.
    lows = [np.full((len(p), FANOUT, FANOUT), np.inf) for p in points]
    highs = [np.full((len(p), FANOUT, FANOUT), -np.inf) for p in points]
    for level, node, child, point, low, high in zip(*(c.to_pylist() for c in told.toArrow().columns), strict=True):
        lows[level][node, point, child] = low
        highs[level][node, point, child] = high
    return placed, Tree(points, lows, highs)


_ASKED = "id long, label long, vector binary, windows array<struct<window: long, low: long, high: long, floor: long>>"


def _visits(asked: DataFrame, tree: Tree, space: _Space, first: bool) -> DataFrame:
    """Anchors with the ``leaves`` next to them, or (not ``first``) all others that may hold what a window still lacks, by ``bucket``.

    Of a large tree an anchor visits many leaves, so it is sent once to each bucket of them.
    """
    width = tree.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = space.anchors(batch.column("vector"))
            least, most, distances = tree.bounds(q)
            n = max(1, round(distances.shape[1] * FIRST))
            near = np.zeros(distances.shape, bool)
            np.put_along_axis(near, np.argsort(distances, axis=1, kind="stable")[:, :n], True, axis=1)
            if first:
                left = near & np.isfinite(least)
            else:
                left = np.zeros(near.shape, bool)
                for k, windows in enumerate(batch.column("windows").to_pylist()):
                    for w in windows:
                        scores = np.array([[w["high"], w["floor"]]], np.float64)
                        inner, outer = space.reach(q[k : k + 1], scores)[0]
                        left[k] |= (least[k] <= outer + space.slack) & (most[k] >= inner - space.slack)
                left &= ~near
            i, leaf = np.nonzero(left)
            bucket = leaf // width
            begins = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(bucket) != 0)][: len(i)])
            leaves = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(i)], pa.int32()), pa.array(leaf))
            each = [c.take(pa.array(i[begins])) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(
                [*each, pa.array(bucket[begins]), leaves], [*batch.schema.names, "bucket", "leaves"]
            )

    return asked.mapInArrow(run, f"{_ASKED}, bucket long, leaves array<long>")


def _met(visits: DataFrame, blocks: DataFrame, groups: int, space: _Space, most: int, same: bool) -> DataFrame:
    """For each window of an anchor the best rows, ``most`` at most, of each block of the visited leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked, rows = batch.column("asked")[k].values, batch.column("rows")[k].values
                lists = asked.field("leaves")
                whose = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                here = whose[lists.flatten().to_numpy() == batch.column("leaf")[k].as_py()]
                if not len(here):
                    continue
                asked = asked.take(pa.array(here))
                ids, labels = rows.field("id").to_numpy(), rows.field("label").to_numpy()
                anchors, own = asked.field("id").to_numpy(), asked.field("label").to_numpy()
                scores = space.numbers(asked.field("vector")) @ space.numbers(rows.field("vector")).T
                scores = scores.astype(np.int64)
                fit = ((own[:, None] == labels) == same) & (anchors[:, None] != ids)
                found = []
                for at, windows in enumerate(asked.field("windows").to_pylist()):
                    for w in windows:
                        row = scores[at]
                        good = np.flatnonzero(fit[at] & (row >= w["floor"]) & (row <= w["high"]))
                        good = good[np.lexsort((ids[good], -row[good]))[:most]]
                        best = zip(ids[good].tolist(), row[good].tolist(), strict=True)
                        found += [(int(anchors[at]), w["window"], i, s) for i, s in best]
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "window", "other", "score"])

    asked = F.collect_list(F.struct("id", "label", "vector", "windows", "leaves")).alias("asked")
    group = F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group")
    # The planner takes visits for as few as the anchors, and would send them all to the driver.
    together = visits.groupBy("bucket", group).agg(asked).join(blocks.hint("merge"), "bucket")
    return together.select("asked", "leaf", "rows").mapInArrow(run, "id long, window long, other long, score long")


def _first_ones(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` highest scores of each window, ties by smaller id, with their ``rank``."""
    order = Window.partitionBy("id", "window").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _searched(asked: DataFrame, blocks: DataFrame, tree: Tree, space: _Space, groups: int, most: int, same: bool) -> DataFrame:
    """``id``, ``window``, ``other``, ``score`` and ``rank`` of what the windows of all anchors hold, exactly."""
    near = _met(_visits(asked, tree, space, first=True), blocks, groups, space, most, same)
    near = stage(_first_ones(near, most), "near")
    full = near.filter(F.col("rank") == most).select("id", "window", F.col("score").alias("end"))
    narrowed = asked.select("id", "label", "vector", F.explode("windows").alias("w")).select(
        "id", "label", "vector", F.col("w.window").alias("window"), "w"
    ).join(full, ["id", "window"], "left")
    window = F.struct("window", "w.low", "w.high", F.coalesce("end", "w.low").alias("floor"))
    narrowed = narrowed.groupBy("id").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.collect_list(window).alias("windows")
    )
    far = _met(_visits(narrowed, tree, space, first=False), blocks, groups, space, most, same)
    return stage(_first_ones(near.drop("rank").unionByName(far), most), "found")


def mine(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW
) -> DataFrame:
    """Hard negatives of each anchor and positive among ``rows(vec_id, label, vector, anchor)``.

    ``vector`` is an array of whole numbers (long) and a score their inner product. An
    anchor (``anchor`` is true) has as positives the ``positives`` other rows of its label with the
    highest scores, and for each of them as negatives the ``negatives`` rows of other labels
    with the highest scores from ``window[0]`` to ``window[1]`` per cent of the positive's.
    Ties go by smaller ``vec_id``. Returns ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score`` and ``negative_score``; a pair without negatives has no row.

    A null ``vec_id``, label, vector or component keeps a row out. A vector shorter than
    others counts as if filled with zeros. Of rows that share a ``vec_id`` only the first
    (by label and vector; an anchor before others) takes part. A positive with a negative score has no
    negatives, as its window is empty. Vectors with scores of 2**56 or more are an
    error. No rows or no anchors give no rows. Other columns are ignored.
    """
    spark = rows.sparkSession
    ready(spark)
    given = rows.select(
        rows["vec_id"].cast("long").alias("id"),
        rows["label"].cast("long").alias("label"),
        rows["vector"].cast("array<long>").alias("vector"),
        F.coalesce(rows["anchor"], F.lit(False)).alias("anchor"),
    ).filter("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    if not given.groupBy("id").count().filter("count > 1").isEmpty():
        one = F.min(F.struct((~F.col("anchor")).alias("other"), "label", "vector")).alias("one")
        given = given.groupBy("id").agg(one).select("id", "one.label", "one.vector", (~F.col("one.other")).alias("anchor"))
    space = _space(given)
    stored = stage(_stored(given, space), "vectors")
    placed, tree = _planted(stored, space)
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / ROWS).alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")
    blocks = join_totals(placed, sizes, "leaf").groupBy("leaf", block)
    blocks = blocks.agg(F.collect_list(F.struct("id", "label", "vector")).alias("rows"))
    blocks = stage(blocks.select(F.expr(f"leaf div {tree.width}").alias("bucket"), "leaf", "rows"), "blocks")
    anchors = stored.filter("anchor").select("id", "label", "vector")
    groups = max(1, math.ceil(anchors.count() / ANCHORS))

    bounds = {"window": 0, "low": LOWEST, "high": HIGHEST, "floor": LOWEST}
    everything = F.struct(*[F.lit(x).cast("long").alias(name) for name, x in bounds.items()])
    asked = anchors.withColumn("windows", F.array(everything))
    best = _searched(asked, blocks, tree, space, groups, positives, same=True)
    window_ = F.col("rank").cast("long").alias("window")
    pairs = best.select("id", window_, F.col("other").alias("positive"), F.col("score").alias("positive_score"))
    # Bounds as whole numbers: the first from window[0] % of the score and the last up to window[1] %.
    low = -F.expr(f"(-{window[0]} * positive_score - pmod(-{window[0]} * positive_score, 100)) div 100")
    high = F.expr(f"({window[1]} * positive_score - pmod({window[1]} * positive_score, 100)) div 100")
    windows = pairs.select("id", F.struct("window", low.alias("low"), high.alias("high"), low.alias("floor")).alias("w"))
    windows = windows.filter("w.low <= w.high").groupBy("id").agg(F.collect_list("w").alias("windows"))
    asked = stage(anchors.join(windows, "id").select("id", "label", "vector", "windows"), "asked")
    found = _searched(asked, blocks, tree, space, groups, negatives, same=False)
    return found.join(pairs, ["id", "window"]).select(
        F.col("id").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
