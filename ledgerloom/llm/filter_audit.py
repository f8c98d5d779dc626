"""How document filters interact: what each of them removes in every order of application.

Five filters look at every document once, and which of them it fails is a mask of
five bits. Documents with one mask behave alike in every order, so a part of the
corpus is no more than 32 mask cells with counts. A recursive common table
expression then enumerates the orders: each level extends every prefix by each
letter that it does not hold yet, joins the mask cells of the part, carries the bits
applied so far, and appends the metrics of its step.

Everything is DataFrame and SQL expressions. Texts are read once and not shuffled:
what moves are a digest, an id and a few flags per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import LAST
from ledgerloom.session import stage

LETTERS = "ABCDE"
BITS = {letter: 1 << k for k, letter in enumerate(LETTERS)}
FEWEST_WORDS = 50
LEAST_DISTINCT = 65  # per cent of the words
MOST_CAPITALS = 5  # per cent of the code points
SYMBOLS = "[#$%&*|]"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_masks(docs: DataFrame) -> DataFrame:
    """``order``, ``part``, ``digest`` and the bits of A to D in ``mask``, one row per row of ``docs``."""
    rows = docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("order"),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.char_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    failed = {
        "A": n < FEWEST_WORDS,
        "B": F.lit(100) * distinct.cast("long") < LEAST_DISTINCT * n.cast("long"),
        "C": F.lit(100) * capitals > MOST_CAPITALS * F.char_length("text").cast("long"),
        "D": F.col("text").rlike(SYMBOLS),
    }
    mask = sum((F.when(failed[x], BITS[x]).otherwise(0) for x in failed), F.lit(0))
    return rows.select("order", "part", F.unhex(F.md5("text")).alias("digest"), mask.alias("mask"))


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask`` (bits of all five filters), ``good`` and ``toxic`` of each row of ``docs``.

    The first document of a text is found by a minimum per digest, which is combined
    before its shuffle; joined back by digest and id, no group of copies is one key.
    """
    rows = stage(text_masks(docs), "filter-masks")
    first = rows.groupBy("digest").agg(F.min("order").alias("order")).withColumn("first", F.lit(True))
    marked = labels.select(
        labels["doc_id"].cast("long").alias("order"),
        (labels["quality"] == 1).cast("int").alias("good"),
        (labels["toxic"] == 1).cast("int").alias("toxic"),
    ).filter("order is not null and (good = 1 or toxic = 1)")
    marked = marked.groupBy("order").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    repeats = F.when(F.col("first"), 0).otherwise(BITS["E"])
    known = F.when(F.col("order") != LAST, F.col("order"))
    rows = rows.join(first, ["digest", "order"], "left").withColumn("known", known)
    return rows.join(marked.withColumnRenamed("order", "known"), "known", "left").select(
        "part",
        F.col("mask").bitwiseOR(repeats).alias("mask"),
        F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


def mask_cells(rows: DataFrame) -> DataFrame:
    """Each part with its mask cells: how many documents fail just these filters, and how many of them are good or toxic."""
    cells = rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum("good").cast("long").alias("good"), F.sum("toxic").cast("long").alias("toxic")
    )
    return cells.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))


def _sum(value: str, where: str) -> str:
    return f"aggregate(c.cells, 0L, (s, x) -> s + CASE WHEN {where} THEN x.{value} ELSE 0L END)"


# Applied bits are those of the prefix, before the new letter.
_FAILS, _GONE = "x.mask & letter.bit <> 0", "x.mask & before.applied <> 0"
_STEP = {
    "kept": _sum("n", "x.mask & (before.applied | letter.bit) = 0"),
    "removed": _sum("n", f"{_FAILS} AND NOT {_GONE}"),
    "redundant": _sum("n", f"{_FAILS} AND {_GONE}"),
    "unique_fails": _sum("n", "x.mask = letter.bit"),
    "good_lost": _sum("good", f"{_FAILS} AND NOT {_GONE}"),
    "toxic_lost": _sum("toxic", f"{_FAILS} AND NOT {_GONE}"),
}
_METRICS = ", ".join(f"'{name}', {value}" for name, value in _STEP.items())
_LETTERS = ", ".join(f"named_struct('name', '{x}', 'bit', {bit})" for x, bit in BITS.items())

ORDERS = f"""
WITH RECURSIVE prefixes(part, prefix, applied, steps) AS (
  SELECT part, '', 0, CAST(array() AS array<struct<{", ".join(f"{m}: bigint" for m in METRICS)}>>) FROM {{cells}}
  UNION ALL
  SELECT c.part, concat(before.prefix, letter.name), before.applied | letter.bit,
         concat(before.steps, array(named_struct({_METRICS})))
  FROM (
    SELECT *, explode(filter(array({_LETTERS}), l -> applied & l.bit = 0)) AS letter
    FROM prefixes WHERE length(prefix) < {len(LETTERS)}
  ) AS before JOIN {{cells}} AS c ON c.part = before.part)
SELECT part, prefix AS filter_order, posexplode(steps) AS (place, step)
FROM prefixes WHERE length(prefix) = {len(LETTERS)}
"""


def _enumerated(cells: DataFrame) -> DataFrame:
    """The rows of ``ORDERS``, written once.

    A part makes 326 rows, and Spark ends a recursion by default at a million. As
    the number of parts has no bound, that limit is off while this runs.
    """
    spark, limit = cells.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        return stage(spark.sql(ORDERS, cells=cells).select("part", "filter_order", "place", "step.*"), "filter-orders")
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of that step.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; ``labels`` ``doc_id``, ``quality`` and ``toxic``. A
    document fails A with under 50 words ``[^\\x20\\x09-\\x0D]+``; B if under 65 % of its
    words are different; C if ``[A-Z]`` are over 5 % of its code points; D if it holds
    one of ``#$%&*|``; E if a row with a smaller ``doc_id`` has the same text, anywhere.
    Returns ``part``, ``filter_order`` (all 120), ``step`` (from 1), ``kept``, ``removed``, ``redundant``
    (fails, but was removed before), ``unique_fails`` (fails this filter only), ``good_lost``,
    ``toxic_lost`` (removed here with such a label) and ``shapley`` (all that the step's filter
    removes from the part in the 120 orders).

    A null text is empty; an empty text fails A only (B and C compare 0 with 0), and
    E where it repeats. A null source is the part "". A null ``doc_id`` counts as the largest
    and has no label. Rows that share ``doc_id`` and text don't fail E by each other.
    Of several label rows of a document one that marks it is enough. No documents give
    no rows. Other columns are ignored, whatever their names.
    """
    cells = stage(mask_cells(masked(docs, labels)), "mask-cells")
    steps = _enumerated(cells).withColumn("step", F.col("place") + 1)
    letter = F.col("filter_order").substr(F.col("step"), F.lit(1))
    shapley = steps.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    found = steps.withColumn("letter", letter).join(shapley, ["part", "letter"])
    return found.select("part", "filter_order", F.col("step").cast("int").alias("step"), *METRICS, "shapley")
