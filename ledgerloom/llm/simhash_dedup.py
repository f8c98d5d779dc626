"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code. A fingerprint has two halves of 32
bits; of two fingerprints that differ in at most two bits, one half differs in at
most one. On 31 bits of a half the perfect Hamming code has covering radius 1:
every half lies within one bit of exactly one code word, its home. A half that is
one bit away lies within 1 + 1 bits of that home. So each fingerprint stands at
its home anchor and is replicated to the 16 anchors within two bits, for both
halves; fingerprints are compared per anchor, and no link is lost.

Equal fingerprints are one row throughout. Where many different fingerprints
share a home (near copies that agree in one half), the other half splits the
anchor further: two halves that differ in at most two bits agree in one of three
parts, so three finer anchors replace the crowded one. Counts of home rows decide
it, and both ways find the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import LAST, identified, join_totals, ready
from ledgerloom.llm.graphs import components
from ledgerloom.llm.words import LOWER, texts_of
from ledgerloom.session import stage

SHINGLE = 3
SEED = 42
MOST_DIFFERING = 2
# Different fingerprints at one home anchor beyond which it is split.
CROWDED = 512
# Bits of a half that the code covers: the length of the Hamming code with 5 check bits.
COVERED = 31
# Parts of the other half for crowded anchors, as (first bit, bits).
PARTS = ((0, 11), (11, 11), (22, 10))
# Shingles whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bits set in more than half of the hashes of all shingles; 0 without words."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate(([0], ends[:-1]))
    size = min(shingle, len(words))
    hash_, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, COUNTED):
        upto = min(n, at + COUNTED)
        pairs = zip(begins[at:upto].tolist(), (ends[at + size - 1 : upto + size - 1] - 1).tolist(), strict=True)
        hashes = np.array([hash_(text[a:b], SEED) for a, b in pairs], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column("row").field("text"))
        found = np.array([fingerprint(t.translate(LOWER).split()) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("order"), batch.column("copy"), pa.array(found.view(np.int64))], ["order", "copy", "print"]
        )


def _syndrome(half: Column) -> Column:
    """Check bits of the Hamming code: 0 on code words, else the place (from 1) of the bit to flip."""
    checks = []
    for k in range(5):
        mask = sum(1 << (place - 1) for place in range(1, COVERED + 1) if place >> k & 1)
        parity = F.bit_count(half.bitwiseAND(F.lit(mask))).cast("long") % 2
        checks.append(F.shiftleft(parity, k))
    return sum(checks[1:], checks[0])


def _half(fingerprints: DataFrame, which: int) -> DataFrame:
    """``print`` with ``half`` (which one), its covered bits and the bits of the other half."""
    low = F.col("print").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("print", 32)
    own, other = (low, high) if which == 0 else (high, low)
    return fingerprints.select(
        "print",
        F.lit(which).cast("long").alias("half"),
        own.bitwiseAND(F.lit((1 << COVERED) - 1)).alias("own"),
        other.alias("other"),
    )


def _bit(place: Column) -> Column:
    """The bit at a place from 1; none for 0."""
    return F.shiftright(F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int")), 1)


def _anchors(fingerprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Home anchors, and all anchors within two bits, as ``(anchor, print, other)``; an anchor tells its half."""
    halves = _half(fingerprints, 0).unionByName(_half(fingerprints, 1))
    marked = halves.withColumn("off", _syndrome(F.col("own")))
    home = F.col("own").bitwiseXOR(_bit(F.col("off")))
    place = F.lit(1 << COVERED).cast("long") * F.col("half")
    homes = marked.select((home + place).alias("anchor"), "print", "other")
    # Flipping places p and p xor off also leads to a code word; each such pair is taken once.
    flips = F.filter(
        F.sequence(F.lit(1).cast("long"), F.lit(COVERED).cast("long")),
        lambda p: (F.col("off") > 0) & (p != F.col("off")) & (p < p.bitwiseXOR(F.col("off"))),
    )
    two_off = F.transform(
        flips, lambda p: F.col("own").bitwiseXOR(_bit(p)).bitwiseXOR(_bit(p.bitwiseXOR(F.col("off"))))
    )
    near = marked.select(F.explode(F.concat(F.array(home), two_off)).alias("near"), "half", "print", "other")
    return homes, near.select((F.col("near") + place).alias("anchor"), "print", "other")


def _finer(rows: DataFrame) -> DataFrame:
    """Rows at crowded anchors, once for each part of the other half."""
    parts = [
        F.struct(F.lit(k).alias("part"), F.shiftright("other", first).bitwiseAND((1 << bits) - 1).alias("value"))
        for k, (first, bits) in enumerate(PARTS)
    ]
    return rows.select("anchor", "print", F.explode(F.array(*parts)).alias("p")).select("anchor", "print", "p.*")


def links(fingerprints: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of different values of ``print`` (long) that differ in at most two bits."""
    distinct = fingerprints.select("print").filter("print is not null").distinct()
    homes, near = _anchors(distinct)
    full = stage(homes.groupBy("anchor").count().filter(F.col("count") > crowded).select("anchor"), "crowded")

    def pairs(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        left = left.select(*keys, F.col("print").alias("x"))
        right = right.select(*keys, F.col("print").alias("y"))
        differing = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
        close = left.join(right, keys).filter((F.col("x") != F.col("y")) & (differing <= MOST_DIFFERING))
        return close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    if full.isEmpty():
        return pairs(homes, near, ["anchor"]).distinct()
    light = [rows.join(full, "anchor", "left_anti") for rows in (homes, near)]
    heavy = [_finer(rows.join(full, "anchor", "left_semi")) for rows in (homes, near)]
    found = pairs(*light, ["anchor"]).unionByName(pairs(*heavy, ["anchor", "part", "value"]))
    return found.distinct()


def fingerprints_of(rows: DataFrame) -> DataFrame:
    """``order``, ``copy`` and ``print`` of each row, staged."""
    ready(rows.sparkSession)
    return stage(rows.mapInArrow(_fingerprints, "order long, copy long, print long"), "fingerprints")


def _grouped(rows: DataFrame, crowded: int) -> DataFrame:
    """``order``, ``copy``, ``print`` and the group (any print of it) of each row."""
    prints = fingerprints_of(rows)
    joined = components(links(prints, crowded)).select(F.col("node").alias("print"), F.col("component").alias("group"))
    groups = prints.select("print").distinct().join(joined, "print", "left")
    return join_totals(prints, groups.select("print", F.coalesce("group", "print").alias("group")), "print")


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row of ``docs``.

    A-Z are lowered, words are ``[^\\x20\\x09-\\x0D]+``, shingles three words. Fingerprints
    link at two or fewer differing bits; ``component_id`` is the smallest ``doc_id``
    reachable over links, a document's own included.

    A null or empty text has no words and fingerprint 0, which links like any
    other; fewer than three words are one shingle. Rows that share a ``doc_id``
    each keep their fingerprint; they aren't linked by the id alone. A null ``doc_id``
    counts as the largest, and a component without any id is null. An empty table
    gives no rows; other columns of ``docs`` are ignored, whatever their names.
    """
    grouped = _grouped(identified(docs.select("doc_id", "text")), crowded)
    least = grouped.groupBy("group").agg(F.min("order").alias("least"))

    def public(order: str) -> Column:
        return F.when(F.col(order) != LAST, F.col(order))

    return join_totals(grouped, least, "group").select(
        public("order").alias("doc_id"),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        public("least").alias("component_id"),
    )


def first_of_groups(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """The first row (by ``order`` and ``copy``) of each group, as it came."""
    first = grouped.groupBy("group").agg(F.min(F.struct("order", "copy")).alias("first")).select("first.*")
    kept = rows.join(first, ["order", "copy"], "left_semi")
    if not grouped.groupBy("order", "copy").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["order", "copy"])
    return kept.select("row.*")


def keep_one(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """The row of ``docs`` with the smallest ``doc_id`` of each component, with all its columns.

    Of rows that share this id the one with the smaller hash of its text stays,
    and of equal rows one. Everything else is as for ``near_duplicates``.
    """
    rows = identified(docs)
    return first_of_groups(rows, _grouped(rows, crowded))
