"""Remove word passages that already stand in an earlier document.

Method: level-wise doubling. A passage of ``window`` words can only repeat where
its parts repeat, so short windows are compared first and only the repeated ones
are extended to (at most) twice their length, up to ``window``:

1. ``window / 4`` words. Not every window is compared: of each passage of
   ``window`` words the part with the smallest hash is taken. Equal passages give
   equal parts, so no repeat is lost, and about one part in ten words is left.
2. ``window / 2`` words, to the right and to the left of each repeated part; a
   passage around the part holds at least one of both.
3. ``window`` words at every place around a repeated half.

Every level groups by hash with a partial minimum and maximum of the document
order (nothing is gathered by key) and joins the survivors back, so a passage
that a third of all documents share is combined before the shuffle and its join
partition can be split. Places of one hash within one text (periodic texts) are
one row. Whole texts are shuffled once, by document; both passes over that
shuffle reuse it.

A text that equals an earlier one as a whole needs no comparison of parts: all its
windows stand there. It leaves after the first level; its original stays in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import identified, join_totals, ready, repeats, row_and
from ledgerloom.llm.words import SPACED, Windows, covered, groups, mix, signed, sliding, spans, texts_of, word_hashes
from ledgerloom.session import stage

WINDOW = 50


def _levels(window: int) -> tuple[int, int, int]:
    return -(-window // 4), -(-window // 2), window


def _key(*hashes: np.ndarray) -> np.ndarray:
    """One hash of several."""
    key = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        key = mix(key * np.uint64(3) + h)
    return key


def _together(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The first row of each key, and the places of its further rows (null where there are none)."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    opens = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if n else np.zeros(0, np.int64)
    if len(opens) == n:
        return np.arange(n), pa.nulls(n, pa.list_(pa.int32()))
    sizes = np.diff(np.append(opens, n)) - 1
    rest = np.delete(places[order], opens)
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(rest), mask=pa.array(sizes == 0)
    )
    return order[opens], lists


def _parts(window: int):
    """Task function: the first level's windows of each text, with the hashes of both extensions."""
    part, half, _ = _levels(window)
    width = window - part + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, order, copy = texts_of(batch.column("text")), batch.column("order"), batch.column("copy")
            for i, j in groups(texts):
                hashes, counts = word_hashes(texts[i:j], SPACED)
                if len(hashes) < window:
                    continue
                ends = np.cumsum(counts)
                begin, end = np.repeat(ends - counts, counts), np.repeat(ends, counts)
                windows, n = Windows(hashes), len(hashes)
                grams = windows.hash(np.arange(n - part + 1), part) | np.uint64(1)
                smallest = sliding(grams, width, np.minimum)
                inside = np.arange(n - window + 1) + window <= end[: n - window + 1]
                smallest = np.where(inside, smallest, np.uint64(0))
                around = sliding(np.pad(smallest, width - 1), width, np.maximum)
                at = np.flatnonzero(around == grams)
                right = at + half <= end[at]
                left = at - (half - part) >= begin[at]
                right_hash, left_hash = np.zeros((2, len(at)), np.uint64)
                right_hash[right] = windows.hash(at[right], half)
                left_hash[left] = windows.hash(at[left] - (half - part), half)
                text = i + np.searchsorted(ends, at, side="right")
                same = mix(_key(grams[at], right_hash, left_hash) ^ text.astype(np.uint64))
                one, more = _together(same, (at - begin[at]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(grams[at[one]])),
                        order.take(pa.array(text[one])),
                        copy.take(pa.array(text[one])),
                        pa.array((at - begin[at])[one].astype(np.int32)),
                        more,
                        pa.array(signed(right_hash[one]), mask=~right[one]),
                        pa.array(signed(left_hash[one]), mask=~left[one]),
                    ],
                    ["hash", "order", "copy", "place", "more", "right", "left"],
                )

    return run


def _passages(window: int):
    """Task function: all windows around the repeated halves of each text."""
    _, half, _ = _levels(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("row").field("text"))
            for k, data in enumerate(texts):
                hashes, _ = word_hashes([data], SPACED)
                n = len(hashes) - window + 1
                if n < 1:
                    continue
                starts = np.asarray(batch.column("places")[k].values, np.int64) - (window - half)
                last = starts + window - half
                starts = np.maximum(starts, 0)
                change = np.zeros(n + 1, np.int32)
                fits = starts < n
                np.add.at(change, starts[fits], 1)
                np.add.at(change, np.minimum(last[fits] + 1, n), -1)
                at = np.flatnonzero(np.cumsum(change[:-1]) > 0).astype(np.int32)
                found = Windows(hashes).hash(at, window)
                one, more = _together(found, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(found[one])),
                        pa.array(np.full(len(one), batch.column("order")[k].as_py())),
                        pa.array(np.full(len(one), batch.column("copy")[k].as_py())),
                        pa.array(at[one]),
                        more,
                    ],
                    ["hash", "order", "copy", "place", "more"],
                )

    return run


def _kept(window: int, one_space: bool):
    """Task function: each text without the words covered by its repeated windows."""

    def cut(data: bytes, gone: np.ndarray | None) -> bytes:
        if one_space:
            words = data.split()
            if gone is not None:
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            return b" ".join(words)
        if gone is None:
            return data
        starts, _ = spans(np.frombuffer(data, np.uint8), SPACED)
        edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
        places, at, kept = np.append(starts, len(data)).tolist(), 0, []
        for first, after in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            kept.append(data[at : places[first]])
            at = places[after]
        kept.append(data[at:])
        return b"".join(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, places = batch.column("row"), batch.column("places")
            whole = batch.column("whole").fill_null(False).to_pylist()
            texts, kept, removed = texts_of(row.field("text")), [], []
            _, counts = word_hashes(texts, SPACED)
            for k, data in enumerate(texts):
                gone, n = None, int(counts[k])
                if whole[k] and n >= window:
                    gone = np.ones(n, bool)
                elif places[k].is_valid:
                    gone = covered(np.asarray(places[k].values, np.int64), window, n)
                kept.append(cut(data, gone))
                removed.append(0 if gone is None else int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [row, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts), pa.array(removed, pa.int64())],
                ["row", "kept", "n_words", "n_removed"],
            )

    return run


def remove_repeated(docs: DataFrame, window: int = WINDOW, one_space: bool = False) -> DataFrame:
    """Each row of ``docs`` with the text that is left of it.

    ``docs`` has ``doc_id`` and ``text``; words are ``[^\\x20\\x09-\\x0D]+``. A word
    goes if a window that covers it also starts in a document with a smaller
    ``doc_id``; windows are judged on the input. Returns ``row`` (all columns of
    ``docs``), ``kept`` (as laid out before, or the words joined by one space),
    ``n_words`` and ``n_removed``.

    A null or empty text has no words and stays empty; a text of fewer than
    ``window`` words loses nothing. A null ``doc_id`` counts as the largest. Rows
    that share a ``doc_id`` are one document: they don't remove each other's words,
    and each loses the same passages. An empty table gives an empty result. Other
    columns pass through ``row`` and can have any name. A text is held whole by one
    task, in arrays of about 30 bytes a word.
    """
    part, half, _ = _levels(window)
    ready(docs.sparkSession)
    repeat = repeats(docs)
    rows = identified(docs, repeat)
    narrow = rows.select("order", "copy", F.col("row.text").alias("text"))
    if repeat:  # equal rows are one until their words are cut
        narrow = stage(narrow.groupBy("order", "copy").agg(F.min("text").alias("text")), "texts")

    def only_repeated(found: DataFrame) -> DataFrame:
        ends = found.groupBy("hash").agg(F.min("order").alias("first"), F.max("order").alias("last"))
        return join_totals(found, ends.filter("first < last").select("hash"), "hash", "left_semi")

    def finished(gone: DataFrame) -> DataFrame:
        more = "kept string, n_words long, n_removed long"
        return rows.join(gone, ["order", "copy"], "left").mapInArrow(_kept(window, one_space), row_and(rows, more))

    def places(found: DataFrame) -> DataFrame:
        lists = F.collect_list(F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<int>"))))
        return found.groupBy("order", "copy").agg(F.flatten(lists).alias("places"))

    texts = narrow.select("order", "copy", F.xxhash64("text").alias("hash"), F.md5("text").alias("digest"))
    originals = texts.groupBy("hash", "digest").agg(F.min("order").alias("first"))
    copies = join_totals(texts.withColumnRenamed("digest", "own"), originals, "hash")
    copies = copies.filter((F.col("own") == F.col("digest")) & (F.col("order") > F.col("first")))
    copies = stage(copies.select("order", "copy").distinct(), "copies")
    whole = copies.select("order", "copy", F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("whole"))

    schema = "hash long, order long, copy long, place int, more array<int>"
    parts = narrow.mapInArrow(_parts(window), f"{schema}, right long, left long")
    hits = only_repeated(parts).drop("hash").join(copies, ["order", "copy"], "left_anti")
    hits = stage(hits, "parts")
    if hits.isEmpty():  # no candidate survives the first level
        return finished(whole)

    ahead = half - part
    before = F.transform("more", lambda x: x - ahead)
    sides = F.array(
        F.struct(F.col("right").alias("hash"), "place", "more"),
        F.struct(F.col("left").alias("hash"), (F.col("place") - ahead).alias("place"), before.alias("more")),
    )
    halves = hits.select("order", "copy", F.explode(sides).alias("side")).select("order", "copy", "side.*")
    around = places(only_repeated(halves.filter("hash is not null")))

    # Where no row repeats, this and the last join share one shuffle of the rows.
    texts = narrow.select("order", "copy", F.struct("text").alias("row")) if repeat else rows
    passages = texts.join(around, ["order", "copy"]).mapInArrow(_passages(window), schema)
    ends = passages.groupBy("hash").agg(F.min("order").alias("first"), F.max("order").alias("last"))
    gone = join_totals(passages, ends.filter("first < last").select("hash", "first"), "hash")
    gone = places(gone.filter(F.col("order") > F.col("first"))).withColumn("whole", F.lit(False))
    return finished(gone.unionByName(whole))
