"""Near copies by MinHash bands and an exact comparison of five-word shingles.

Two texts are near copies if their sets of shingles have a Jaccard similarity of at
least 0.8. SimHash prints of such texts differ in 3 to 11 bits, too many for
anchors, so the candidates come from bands: texts that agree in the smallest values
under all hash functions of a band share a bucket. A pair at similarity s meets
with probability 1 - (1 - s**ROWS)**BANDS, 0.9999 at 0.8. Every candidate is then
compared by its whole sets, so no link is wrong.

Equal sets are one row throughout. In turns the most central text of each bucket, the
one that shares buckets with the most others, is compared with all groups it isn't in:
edited copies are likely alike to what they were made from, if not to each other. A
turn is linear. What the turns leave apart is compared across groups where the rarest
shingles of two texts allow the similarity, so no candidate is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import simhash_dedup
from ledgerloom.llm.frames import identified, join_totals, ready
from ledgerloom.llm.graphs import components
from ledgerloom.llm.simhash_dedup import first_of_groups
from ledgerloom.llm.words import LOWER, SPACED, Windows, groups, mix, texts_of, word_hashes
from ledgerloom.session import stage

SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 24, 5
# Turns at most; a turn that finds nothing is the last one. What more turns would find, the last step does.
TURNS = 2
SLACK = 1e-6

_pick = np.random.default_rng(42)
_FLIPS = _pick.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_FACTORS = _pick.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted hashes of the different shingles of each text; a text of fewer words is one shingle."""
    found = []
    for i, j in groups(texts):
        hashes, counts = word_hashes([t.translate(LOWER) for t in texts[i:j]], SPACED)
        windows, ends = Windows(hashes), np.cumsum(counts)
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            size = min(SHINGLE, n)
            starts = np.arange(end - n, end - size + 1) if n else np.zeros(0, np.int64)
            found.append(np.unique(windows.ranges(starts, starts + size)) if n else np.zeros(0, np.uint64))
    return found


def buckets(sets: list[np.ndarray]) -> np.ndarray:
    """A bucket for each set, none empty, and each band."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    found = np.zeros((len(sets), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        band = k // ROWS
        least = np.minimum.reduceat((values ^ _FLIPS[k]) * _FACTORS[k], starts)
        found[:, band] = mix(found[:, band] + least.astype(np.uint64) + np.uint64(band << 32))
    return found


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, prints, sizes, places = texts_of(batch.column("row").field("text")), [], [], []
        for i, j in groups(texts):
            sets = shingle_sets(texts[i:j])
            prints += [int(mix(mix(s).sum(keepdims=True))[0]) if len(s) else 0 for s in sets]
            sizes += map(len, sets)
            some = [s for s in sets if len(s)]
            own = iter(buckets(some).view(np.int64).tolist() if some else [])
            places += [next(own) if len(s) else [] for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("order"),
                batch.column("copy"),
                pa.array(np.array(prints, np.uint64).view(np.int64)),
                pa.array(sizes, pa.int64()),
                pa.array(places, pa.list_(pa.int64())),
            ],
            ["order", "copy", "print", "size", "buckets"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(texts_of(batch.column("row").field("text")))]
        yield pa.RecordBatch.from_arrays([batch.column("print"), pa.array(sets, pa.binary())], ["print", "set"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, prints = texts_of(batch.column("row").field("text")), batch.column("print").to_numpy()
        for i, j in groups(texts):
            sets = shingle_sets(texts[i:j])
            sizes = np.array([len(s) for s in sets], np.int64)
            arrays = np.repeat(prints[i:j], sizes), np.repeat(sizes, sizes), np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["print", "size", "shingle"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alike = []
        for a, b in zip(batch.column("left"), batch.column("right"), strict=True):
            both = np.concatenate([np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)])
            both.sort(kind="stable")
            common = np.count_nonzero(both[1:] == both[:-1])
            alike.append(bool(common >= LIKENESS * (len(both) - common)))
        yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))


def _texts(rows: DataFrame, prints: DataFrame, asked: DataFrame) -> DataFrame:
    """``row`` and ``print``, one row for each of ``asked(print)``."""
    first = prints.groupBy("print").agg(F.min(F.struct("order", "copy")).alias("first"))
    read = first.join(asked, "print").select("print", "first.*")  # a semi join would move below the minimum
    return rows.join(read, ["order", "copy"]).select("row", "print")


def _links(rows: DataFrame, prints: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Those ``pairs(a, b)`` of prints whose sets are alike."""
    pairs = stage(pairs.distinct(), f"{name}-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct()
    sets = _texts(rows, prints, asked).mapInArrow(_sets, "print long, set binary")
    sets = stage(sets.dropDuplicates(["print"]), f"{name}-sets")
    left = pairs.join(sets.select(F.col("print").alias("a"), F.col("set").alias("left")), "a")
    both = left.join(sets.select(F.col("print").alias("b"), F.col("set").alias("right")), "b")
    return stage(both.select("a", "b", "left", "right").mapInArrow(_alike, "a long, b long"), f"{name}-links")


def _across(rows: DataFrame, prints: DataFrame, apart: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of different groups of ``apart(print, group)`` that can be alike; none that are is missing.

    Shingles of a text are put in order, rare ones first. If two texts are alike, then
    at the first shingle they share enough must be left of both to be shared, so
    only the first fifth of a text is looked up, and what edited copies have in
    common lies behind their edits.
    """
    asked = apart.select("print", "group").distinct()
    shingles = _texts(rows, prints, asked.select("print")).mapInArrow(_shingles, "print long, size long, shingle long")
    shingles = stage(shingles.dropDuplicates(["print", "shingle"]), "shingles")
    shared = shingles.groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1")
    found = join_totals(shingles, shared, "shingle")
    order = "OVER (PARTITION BY print ORDER BY texts, shingle)"
    # Shingles that one text alone has come first of all.
    places = found.withColumn("place", F.expr(f"size - count(*) OVER (PARTITION BY print) + row_number() {order} - 1"))
    first = places.filter(F.col("place") <= F.col("size") * (1 - LIKENESS) + SLACK)
    first = stage(first.select("shingle", "print", "size", "place").join(asked, "print"), "first-shingles")
    x, y = (
        first.select("shingle", *(F.col(c).alias(f"{side}_{c}") for c in ("print", "group", "size", "place")))
        for side in "ab"
    )
    left = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    enough = left >= LIKENESS / (1 + LIKENESS) * (F.col("a_size") + F.col("b_size")) - SLACK
    alike = (F.col("a_group") < F.col("b_group")) & _close("a_size", "b_size") & enough
    return x.join(y, "shingle").filter(alike).select(F.col("a_print").alias("a"), F.col("b_print").alias("b"))


def _close(one: str, other: str):
    """Sizes that allow the likeness."""
    return F.least(one, other) >= LIKENESS * F.greatest(one, other)


def _groups(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("print"), F.col("component").alias("group"))


def _near_links(prints: DataFrame, near: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between prints of sets whose texts have equal or linked SimHash prints.

    The least print of a set stands for each SimHash print, so there are as many links as
    different pairs of both prints, and as SimHash prints have links.
    """
    close = simhash_dedup.links(near)
    # Equal rows share order and copy, and both prints; one of them tells.
    key = ["order", "copy"]
    near = near.select(*key, F.col("print").alias("near")).dropDuplicates(key)
    told = stage(near.join(prints.select(*key, "print").dropDuplicates(key), key).select("near", "print").distinct(), "told")
    least = stage(told.groupBy("near").agg(F.min("print").alias("least")), "least")
    equal = join_totals(told, least, "near").filter("least < print").select(F.col("least").alias("a"), F.col("print").alias("b"))
    for end in ("a", "b"):
        close = join_totals(close, least.toDF(end, f"least_{end}"), end)
    return stage(equal.unionByName(close.select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))), "near-links")


def _apart(placed: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one group, with their ``group``.

    Texts that have led a bucket are not among ``placed`` there: they were compared with all
    of it, so that what is still to be compared is between the others.
    """
    told = join_totals(placed, known, "print", "left").withColumn("group", F.coalesce("group", "print"))
    told = stage(told, "told")
    split = told.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high")
    return stage(join_totals(told, split.select("bucket"), "bucket"), "apart")


def _grouped(rows: DataFrame, turns: int, near: DataFrame | None = None) -> DataFrame:
    """``order``, ``copy``, ``print`` and the group (any print of it) of each row.

    Rows may have SimHash prints ``near(order, copy, print)``; links of these then close groups as well.
    """
    ready(rows.sparkSession)
    schema = "order long, copy long, print long, size long, buckets array<long>"
    prints = stage(rows.mapInArrow(_prints, schema), "prints")
    nodes = prints.groupBy("print").agg(F.min("size").alias("size"), F.first("buckets").alias("buckets"))
    placed = stage(nodes.select("print", "size", F.explode("buckets").alias("bucket")), "buckets")
    shared = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    placed = stage(join_totals(placed, shared, "bucket"), "shared")
    central = placed.groupBy("print").agg(F.sum("n").alias("weight"))
    apart = stage(join_totals(placed.drop("n"), central, "print"), "central")

    # In every turn the next most central text of each bucket meets the groups that it isn't in.
    links = rows.sparkSession.createDataFrame([], "a long, b long")
    known = rows.sparkSession.createDataFrame([], "print long, group long")
    apart = apart.withColumn("group", F.col("print"))
    for turn in range(turns):
        rank = F.struct("weight", "print")
        lead = apart.groupBy("bucket").agg(F.max_by(F.struct("print", "size", "group"), rank).alias("lead"))
        met = join_totals(apart, lead, "bucket")
        asked = met.filter((F.col("group") != F.col("lead.group")) & _close("size", "lead.size"))
        asked = asked.select(F.least("print", "lead.print").alias("a"), F.greatest("print", "lead.print").alias("b"))
        found = _links(rows, prints, asked, f"led-{turn}")
        last = found.isEmpty()
        # A text that has led its bucket is done there.
        rest = join_totals(apart.drop("group"), lead, "bucket").filter(F.col("print") != F.col("lead.print")).drop("lead")
        if not last:
            links = links.unionByName(found)
            known = _groups(links)
        apart = _apart(rest, known)
        if last:
            break

    links = links.unionByName(_links(rows, prints, _across(rows, prints, apart), "across"))
    if near is not None:
        links = links.unionByName(_near_links(prints, near))
    all_ = prints.select("print").distinct().join(_groups(links), "print", "left")
    all_ = all_.select("print", F.coalesce("group", "print").alias("group"))
    return join_totals(prints.select("order", "copy", "print"), all_, "print")


def keep_one(docs: DataFrame, turns: int = TURNS) -> DataFrame:
    """The row of ``docs`` with the smallest ``doc_id`` of each group of near copies, with all its columns.

    A-Z are lowered, words are ``[^\\x20\\x09-\\x0D]+``, shingles five words (the whole
    text where it has fewer). Groups are closed over links of similarity 0.8 or more.
    Texts without words are equal. Of rows that share the smallest id the one with the
    smaller hash of its text stays, and of equal rows one. ``turns`` changes the work
    but no link.
    """
    rows = identified(docs)
    return first_of_groups(rows, _grouped(rows, turns))


def keep_one_of_both(docs: DataFrame) -> DataFrame:
    """``keep_one`` with groups closed over links of SimHash prints, as ``simhash_dedup`` finds them, as well.

    The prints weigh repeated shingles, which the sets do not; the sets find edits that
    change more than two bits.
    """
    rows = identified(docs)
    return first_of_groups(rows, _grouped(rows, TURNS, simhash_dedup.fingerprints_of(rows)))
