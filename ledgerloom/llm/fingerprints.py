"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit codes.

Each shingle is hashed once. The hash picks one of ``bins`` and a value; a bin
keeps its smallest value. An empty bin copies the value of another one: it draws
bins from its own hash sequence until it meets a filled one. Of each bin the
lowest ``bits`` bits are kept and packed. Two random bins agree in these bits with
probability 2**-bits, which the estimate takes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import LAST, ready
from ledgerloom.llm.words import SPACED, Windows, groups, mix, texts_of, word_hashes

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class MinHash:
    """``bins`` is a power of two; ``bits`` is 8 or 16, the bits kept of a bin."""

    shingle: int = 5
    bins: int = 256
    bits: int = 8

    @property
    def code(self) -> np.dtype:
        return np.dtype({8: np.uint8, 16: ">u2"}[self.bits])

    def fingerprints(self, texts: list[bytes]) -> np.ndarray:
        """A row of codes for each text. A text without words has all bins at the code 0."""
        hashes, counts = word_hashes(texts, SPACED)
        found = np.full(len(texts) * self.bins, EMPTY)
        if len(hashes):
            windows, ends = Windows(hashes), np.cumsum(counts)
            text = np.repeat(np.arange(len(texts)), counts)
            starts = np.arange(len(hashes))
            after = starts + self.shingle
            whole = after <= ends[text]
            # A text of fewer words than a shingle has one, the whole text.
            whole |= (counts[text] < self.shingle) & (starts == ends[text] - counts[text])
            starts, text = starts[whole], text[whole]
            values = windows.ranges(starts, np.minimum(after[whole], ends[text]))
            shift = np.uint64(64 - (self.bins - 1).bit_length())
            np.minimum.at(found, text * self.bins + (values >> shift).astype(np.int64), values)
        found = found.reshape(len(texts), self.bins)
        self._densify(found, counts > 0)
        codes = (mix(found) & np.uint64((1 << self.bits) - 1)).astype(self.code)
        codes[counts == 0] = 0
        return codes

    def _densify(self, found: np.ndarray, some: np.ndarray) -> None:
        filled = found != EMPTY
        row, bin_ = np.nonzero(~filled & some[:, None])
        value, draw = np.empty(len(row), np.uint64), np.zeros(len(row), np.uint64)
        todo = np.arange(len(row))
        while len(todo):
            draw[todo] += np.uint64(1)
            drawn = mix(bin_[todo].astype(np.uint64) << np.uint64(32) | draw[todo])
            other = (drawn & np.uint64(self.bins - 1)).astype(np.int64)
            hit = filled[row[todo], other]
            value[todo[hit]] = found[row[todo[hit]], other[hit]]
            todo = todo[~hit]
        found[row, bin_] = value

    def likeness(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Estimated share of common shingles: agreeing bins without those that agree by chance."""
        chance = 2.0**-self.bits
        return np.clip(((left == right).mean(1) - chance) / (1 - chance), 0.0, 1.0)


def _hex(codes: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in codes]


def fingerprints(docs: DataFrame, minhash: MinHash = MinHash()) -> DataFrame:
    """``doc_id`` and ``fingerprint`` (hex digits) of each row of ``docs``; nothing is shuffled.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null text counts as empty; its fingerprint is
    all zeros. Equal texts have equal fingerprints, repeated rows repeated results,
    an empty table none; other columns are ignored.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = texts_of(batch.column("text")), []
            for i, j in groups(texts):
                found += _hex(minhash.fingerprints(texts[i:j]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "fingerprint"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, fingerprint string")


def likeness(left: Column, right: Column, minhash: MinHash = MinHash()) -> Column:
    """Estimated likeness, 0 to 1, of two fingerprints given as hex digits; two empty texts are alike."""
    width = minhash.bits // 4
    places = F.sequence(F.lit(1), F.lit(minhash.bins * width), F.lit(width))
    agree = F.size(F.filter(places, lambda p: F.substring(left, p, width) == F.substring(right, p, width)))
    chance = 2.0**-minhash.bits
    return F.greatest(F.lit(0.0), (agree / minhash.bins - chance) / (1 - chance))


def _dealt(docs: DataFrame, ranges: int) -> DataFrame:
    """``order``, ``tie``, ``doc_id``, ``text`` in one partition per range of ids, sorted.

    Bounds are quantiles of the ids. The first row of each range is also the last
    one, marked ``tail``, of the range before (cyclically). Only bounds and first
    keys of ranges, a few numbers each, are read to the driver.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("order"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    shares = [k / ranges for k in range(1, ranges)]
    found = keyed.agg(F.percentile_approx("order", shares, 10 * ranges)).first()[0] if shares else []
    bounds = np.unique(np.array(found or [], np.int64))

    @F.arrow_udf("int")
    def range_of(order: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, order.to_numpy(), side="right").astype(np.int32))

    ranged = keyed.withColumn("range", range_of("order"))
    ids = ranged.select("range", F.struct("order", "tie").alias("key"))
    firsts = sorted(ids.groupBy("range").agg(F.min("key").alias("key")).collect())
    before = [(r["range"], firsts[k - 1]["range"], *r["key"]) for k, r in enumerate(firsts)]
    heads = spark.createDataFrame(before, "range int, before int, first_order long, first_tie long")
    first = (F.col("order") == F.col("first_order")) & (F.col("tie") == F.col("first_tie"))
    own = F.struct(F.col("range").alias("to"), F.lit(False).alias("tail"))
    tail = F.struct(F.col("before").alias("to"), F.lit(True).alias("tail"))
    copies = ranged.join(F.broadcast(heads), "range").withColumn(
        "place", F.explode(F.when(first, F.array(own, tail)).otherwise(F.array(own)))
    )
    dealt = copies.select("order", "tie", "doc_id", "text", "place.*").repartitionById(len(bounds) + 1, F.col("to"))
    return dealt.sortWithinPartitions("tail", "order", "tie").select("doc_id", "text", "tail")


def edited_neighbours(docs: DataFrame, minhash: MinHash = MinHash(), ranges: int | None = None) -> DataFrame:
    """Fingerprints of all texts and of texts edited with the next document, and how alike they are.

    The edited text of a document of ``n_chars`` code points has its last
    floor(n_chars / 4) replaced by as many first ones (or all) of the next document by
    ascending ``doc_id``; after the last comes the first. Returns ``doc_id``,
    ``n_chars``, ``edited``, ``fingerprint``, ``edited_fingerprint``, ``near_edited`` and
    ``near_next``.

    Documents are shuffled once, to ranges of ids (as many as shuffle partitions,
    unless given), and sorted there. A null text counts as empty. A null ``doc_id``
    comes last; rows that share a ``doc_id`` order by a hash of their text. One row
    alone is its own next document. An empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    ready(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
        """All but the last text, which is the next one of the last but one."""
        cuts = [len(t) - len(t) // 4 for t in texts[:-1]]
        edited = [t[:c] + n[: len(t) - c] for t, c, n in zip(texts, cuts, texts[1:], strict=False)]
        plain = [t.encode() for t in texts]
        own = np.concatenate([minhash.fingerprints(plain[i:j]) for i, j in groups(plain)])
        plain = [t.encode() for t in edited]
        other = np.concatenate([minhash.fingerprints(plain[i:j]) for i, j in groups(plain)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array(edited, pa.string()),
                pa.array(_hex(own[:-1])),
                pa.array(_hex(other)),
                pa.array(minhash.likeness(own[:-1], other)),
                pa.array(minhash.likeness(own[:-1], own[1:])),
            ],
            ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, over = [], [], False
        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "tail")), strict=True)
            for doc_id, text, tail in columns:
                if over:  # repeated rows can be heads of the next range together; one is enough
                    continue
                texts.append(text)
                ids.append(doc_id)
                over = tail
            if len(texts) > 1:
                yield rows(ids[:-1], texts)
                ids, texts = ids[-1:], texts[-1:]

    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string"
    return _dealt(docs.select(F.col("doc_id").cast("long"), "text"), ranges).mapInArrow(
        run, f"{schema}, near_edited double, near_next double"
    )
