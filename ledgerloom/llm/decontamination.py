"""Find benchmark passages in training documents with an FM-index per shard.

Each task cuts its documents into shards of bounded size, builds an FM-index over
the words of a shard, searches all benchmark windows in it backwards through
wavelet-tree ranks, locates the hits by sampled suffix positions, and merges
them to spans of words per document. No document is shuffled. Words that no
benchmark item has can't be in a hit; in the index a run of them is a separator.

The benchmark is a stated query set. It is read in blocks of bounded size, each with
its own alphabet. One block is searched in the pass that cuts the texts; of several
each takes a pass of its own, so neither the driver nor a task ever holds two, and
what they find, without texts, is merged.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.fm_index import FMIndex
from ledgerloom.llm.frames import as_row, identified, ready, row_and
from ledgerloom.llm.words import ALNUM, ALNUM_BLANKS, covered, groups, spans, texts_of, word_hashes
from ledgerloom.session import stage

WINDOW = 10
# Words of benchmark text in one block; a block takes about 100 bytes a word.
BLOCK_WORDS = 500_000
# Words in one index; it takes about 60 bytes a word while it is built.
SHARD_WORDS = 1_000_000
NO_ITEM = -(1 << 63)


@dataclass
class Block:
    """Distinct windows of some benchmark items, as symbols, and the items that have each."""

    vocabulary: np.ndarray  # sorted word hashes; symbol = index + 1
    patterns: np.ndarray
    lengths: np.ndarray
    first: np.ndarray  # items of window w: items[first[w]:first[w + 1]]
    items: np.ndarray


def _block(items: list[tuple[int | None, np.ndarray]], window: int) -> Block:
    vocabulary = np.unique(np.concatenate([words for _, words in items]))
    rows, owners = [], []
    for item, words in items:
        symbols = np.searchsorted(vocabulary, words) + 1
        size = min(window, len(symbols))
        views = np.lib.stride_tricks.sliding_window_view(symbols, size)
        rows.append(np.pad(views, ((0, 0), (0, window - size))))
        owners.append(np.full(len(views), NO_ITEM if item is None else item))
    patterns, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], 1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1))
    return Block(vocabulary, patterns, (patterns > 0).sum(1), first, pairs[:, 1])


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Block]:
    items, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words, _ = word_hashes([(row[1] or "").encode().translate(ALNUM_BLANKS)], ALNUM)
        if len(words):
            items.append((row[0], words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield _block(items, window)
            items, size = [], 0
    if items:
        yield _block(items, window)


def _search(block: Block, hashes: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows in the words of a shard of texts that end at ``ends``, and which windows they are."""
    slot = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
    symbols = np.where(block.vocabulary[slot] == hashes, slot + 1, 0)
    symbols = np.insert(symbols, ends, 0)  # a text ends
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    keep[-1] = True
    place = np.flatnonzero(keep)
    if len(place) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = FMIndex(symbols[place], len(block.vocabulary) + 1)
    which, low, high = index.search(block.patterns, block.lengths)
    count = high - low
    rows = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
    found = place[index.locate(rows)]
    return found - np.searchsorted(ends + np.arange(len(ends)), found), np.repeat(which, count)


def _hits(
    hashes: np.ndarray, counts: np.ndarray, block: Block, window: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, word places and windows of all hits, shard by shard."""
    ends = np.cumsum(counts)
    # A text that is too long for one shard goes to several that overlap by a window.
    for at in range(0, len(hashes), SHARD_WORDS):
        upto = min(len(hashes), at + SHARD_WORDS + window - 1)
        inner = ends[(ends > at) & (ends < upto)] - at
        place, which = _search(block, hashes[at:upto], np.append(inner, upto - at), window)
        place += at
        text = np.searchsorted(ends, place, side="right")
        yield text, place - (ends - counts)[text], which


def _cut(data: bytes, hit: np.ndarray) -> bytes:
    """``data`` without the hit words and what stands between them."""
    starts, ends = spans(np.frombuffer(data.translate(ALNUM_BLANKS), np.uint8), ALNUM)
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    at, kept = 0, []
    for first, after in zip(edges[::2], edges[1::2], strict=True):
        kept.append(data[at : starts[first]])
        at = ends[after - 1]
    kept.append(data[at:])
    return b"".join(kept)


def _found(texts: list[bytes], blocks: list, window: int) -> tuple[np.ndarray, list[np.ndarray], list[set[int]]]:
    """The number of words of each text, flags of the hit ones (no flags if none is), and the items found in it."""
    hit = [np.zeros(0, bool)] * len(texts)
    items: list[set[int]] = [set() for _ in texts]
    counts = np.zeros(len(texts), np.int64)
    for i, j in groups(texts):
        hashes, counts[i:j] = word_hashes([t.translate(ALNUM_BLANKS) for t in texts[i:j]], ALNUM)
        for shared in blocks:
            block: Block = shared.value
            for text, place, which in _hits(hashes, counts[i:j], block, window):
                if not len(text):
                    continue
                order = np.argsort(text, kind="stable")
                text, place, which = text[order], place[order], which[order]
                cuts = np.flatnonzero(np.diff(text, prepend=-1))
                for a, b in zip(cuts, np.append(cuts[1:], len(text)), strict=True):
                    k = i + int(text[a])
                    flags = np.zeros(counts[k], bool)
                    for size in np.unique(block.lengths[which[a:b]]):
                        same = block.lengths[which[a:b]] == size
                        flags |= covered(place[a:b][same], int(size), int(counts[k]))
                    hit[k] = hit[k] | flags if len(hit[k]) else flags
                    for w in np.unique(which[a:b]):
                        items[k].update(block.items[block.first[w] : block.first[w + 1]].tolist())
    return counts, hit, items


def _edges(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2)]


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
_FOUND = "spans array<struct<first: long, after: long>>, items array<long>"


def _spans(hits: list[np.ndarray]) -> pa.Array:
    return pa.array([[{"first": a, "after": b} for a, b in _edges(hit)] for hit in hits], _SPANS)


def _results(row: pa.Array, texts: list[bytes], counts: np.ndarray, hit: list[np.ndarray], items: list[set[int]]) -> pa.RecordBatch:
    clean = [_cut(data, flags) if flags.any() else data for data, flags in zip(texts, hit, strict=True)]
    listed = pa.array([sorted(s - {NO_ITEM}, key=str) for s in items], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [row, pa.array(counts), _spans(hit), listed, pa.array(clean, pa.binary()).cast(pa.string())],
        ["row", "n_words", "spans", "items", "clean"],
    )


def _in_one_pass(blocks: list, window: int):
    """Task function for a benchmark of one block at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("row").field("text"))
            yield _results(batch.column("row"), texts, *_found(texts, blocks, window))

    return run


def _of_block(shared, window: int):
    """Task function: what one block of several finds, for the rows where it finds anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, hit, items = _found(texts_of(batch.column("row").field("text")), [shared], window)
            arrays = [batch.column("order"), batch.column("copy"), _spans(hit), pa.array([sorted(s) for s in items], pa.list_(pa.int64()))]
            found = pa.RecordBatch.from_arrays(arrays, ["order", "copy", "spans", "items"])
            yield found.filter(pa.array([len(s) > 0 for s in items], pa.bool_()))

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: rows with what all blocks have found in them."""
    for batch in batches:
        texts = texts_of(batch.column("row").field("text"))
        _, counts = word_hashes([t.translate(ALNUM_BLANKS) for t in texts], ALNUM)
        hit, items = [], []
        for n, spans_, items_ in zip(counts.tolist(), *(batch.column(c).to_pylist() for c in ("spans", "items")), strict=True):
            flags = np.zeros(n if spans_ else 0, bool)
            for x in (x for some in spans_ or () for x in some):
                flags[x["first"] : x["after"]] = True
            hit.append(flags)
            items.append({x for some in items_ or () for x in some})
        yield _results(batch.column("row"), texts, counts, hit, items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans of benchmark windows in each row of ``docs``.

    A-Z are lowered and words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is
    ``window`` consecutive words of an item; an item of fewer words, but not none, is
    one window. Returns ``row`` (all columns of ``docs``), ``n_words``, ``spans`` (runs
    of words inside any occurrence, ``first`` up to but without ``after``), ``items``
    (ids with occurring windows, ordered as strings) and ``clean`` (the text without
    the spans).

    A null or empty text has no words; its ``clean`` is empty. An empty benchmark
    gives no spans, an empty table no rows. Repeated rows get equal results; items
    that share an id count once; items without an id are found but
    not listed. Long texts are indexed in several overlapping shards.
    """
    spark = docs.sparkSession
    ready(spark)
    blocks = _blocks(benchmark, window)
    some = list(itertools.islice(blocks, 2))
    more = f"n_words long, {_FOUND}, clean string"
    if len(some) < 2:
        rows = as_row(docs)
        return rows.mapInArrow(_in_one_pass([spark.sparkContext.broadcast(b) for b in some], window), row_and(rows, more))
    rows, hits = identified(docs), []
    for block in itertools.chain(some, blocks):
        shared = spark.sparkContext.broadcast(block)
        hits.append(stage(rows.mapInArrow(_of_block(shared, window), f"order long, copy long, {_FOUND}"), "hits"))
        shared.destroy()
    # Equal rows have equal hits, and a set holds those once.
    found = reduce(DataFrame.unionByName, hits).groupBy("order", "copy")
    found = found.agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"))
    return rows.join(found, ["order", "copy"], "left").mapInArrow(_merged, row_and(rows, more))
