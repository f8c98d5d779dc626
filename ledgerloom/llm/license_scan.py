"""License scan by ordered signature rules, with DataFrame functions only.

A text is reduced to lower-case words joined by one blank. A keyword prefilter
picks the rules that can match at all; each of them finds all its places with one
regular expression. Places are intervals of the reduced text: an interval inside
another one is suppressed, the better priority standing among equal ones, and of
any two that overlap in part the one with the worse priority goes. Both take sorted
windows: all that ends before, and what starts no farther than the longest match.

The counts of the base phrases come from the text alone. Only documents that
hold a keyword go on to the rules, and only their detections, without any text,
are shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.frames import identified
from ledgerloom.llm.license_rules import Rule, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases, as words, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_CONFIDENCE = 0.6
# Characters that no match is longer than; all repeats in the rules are bounded.
SPAN = 1 << 12
# No reduced text holds it.
MARK = "\u0001"


def _reduced(text: Column) -> Column:
    """Words between single blanks, with a blank before the first and after the last; one blank without words."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), SEPARATORS, " ")


def _with_words(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``words``, the reduced text.

    It is made by a generator, which the planner doesn't look into: as a plain
    expression it would be copied into every use of it, also into each step of a loop.
    """
    return rows.select(*columns, F.explode(F.array(_reduced(F.col("row.text")))).alias("words"))


def _blanks(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _base(words: str) -> list[Column]:
    """Counts and places of the base phrases, which share no word and so can't overlap."""
    text = F.col(words)
    any_of = "(?:" + "|".join(BASE) + ")"
    one = f"(?<= ){any_of}(?= )"
    has = [F.contains(text, F.lit(f" {p} ")) for p in BASE]
    found = has[0] | has[1] | has[2]
    before_last = F.regexp_extract(text, f"(?s)^(.*)(?<= ){any_of}(?= )", 1)
    labels = F.filter(F.array(*[F.when(h, F.lit(v)) for h, v in zip(has, BASE.values(), strict=True)]), F.isnotnull)
    return [
        F.when(found, F.regexp_count(text, F.lit(one)).cast("long")).otherwise(F.lit(0).cast("long")).alias("n_base"),
        F.when(found, _blanks(F.split(text, one, 2)[0]) - 1).alias("first_word"),
        F.when(found, _blanks(before_last) - 1).alias("last_word"),
        F.sort_array(labels).alias("base"),
    ]


def _detections(rows: DataFrame, signatures: Sequence[Rule]) -> DataFrame:
    """``order``, ``copy``, ``priority``, ``label``, ``confidence``, ``first`` up to but without ``after`` (characters)."""
    keywords = sorted({r.keyword for r in signatures})
    by_keyword = {k: [vars(r) for r in signatures if r.keyword == k] for k in keywords}
    rule = "array<struct<priority: int, label: string, pattern: string, confidence: double>>"
    table = F.from_json(F.lit(json.dumps(list(by_keyword.values()))), f"array<{rule}>")
    literals = F.from_json(F.lit(json.dumps([f" {k}" for k in keywords])), "array<string>")
    # One look at each word leaves the keywords whose longest word the text has: a few, mostly none.
    gates = [max(k.split()[:-1] or [k], key=len) for k in keywords]
    listed = F.from_json(F.lit(json.dumps(gates)), "array<string>")
    hits = F.array_intersect(F.split("words", " "), F.array_distinct(listed))
    hit = rows.select("order", "copy", "words", F.explode(F.array(hits)).alias("hits")).filter(F.size("hits") > 0)
    held = F.filter(
        F.sequence(F.lit(0), F.lit(len(keywords) - 1)),
        lambda k: F.array_contains("hits", listed[k]) & F.contains(F.col("words"), literals[k]),
    )
    tried = hit.select("order", "copy", "words", F.explode(held).alias("k"))
    tried = tried.select("order", "copy", "words", F.explode(table[F.col("k")]).alias("rule"))
    # One pass marks all matches; between the marks gaps and matches take turns.
    pattern = F.concat(F.lit("(?<= )(?:"), F.col("rule.pattern"), F.lit(")(?= )"))
    marked = F.split(F.regexp_replace("words", pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    sizes = tried.select(
        "order",
        "copy",
        "rule.priority",
        "rule.label",
        "rule.confidence",
        F.explode(F.array(F.transform(marked, F.char_length))).alias("sizes"),
    ).filter(F.size("sizes") > 1)
    # Repeated rows share their sizes, and sums over both would shift all places; the window needs this shuffle anyway.
    sizes = sizes.dropDuplicates(["order", "copy", "priority"])
    parts = sizes.select(
        "order", "copy", "priority", "label", "confidence", F.posexplode("sizes").alias("k", "size")
    )
    upto = Window.partitionBy("order", "copy", "priority").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum("size").over(upto)
    return (
        parts.withColumn("after", after)
        .filter("k % 2 = 1")
        .select(
            "order", "copy", "priority", "label", "confidence", (F.col("after") - F.col("size")).alias("first"), "after"
        )
    )


def _standing(found: DataFrame) -> DataFrame:
    """Detections that no other one suppresses."""
    place = Window.partitionBy("order", "copy").orderBy("first", F.col("after").desc(), "priority")
    earlier = place.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max("after").over(earlier) >= F.col("after"), F.lit(False))
    outer = found.withColumn("inside", inside).filter(~F.col("inside"))
    # What is left starts at different places, so no more than SPAN can overlap one from either side.
    near = Window.partitionBy("order", "copy").orderBy("first").rangeBetween(-SPAN, SPAN)
    around = outer.withColumn("around", F.collect_list(F.struct("first", "after", "priority")).over(near))
    beaten = F.exists(
        "around",
        lambda x: (x["first"] < F.col("after")) & (x["after"] > F.col("first")) & (x["priority"] < F.col("priority")),
    )
    return around.filter(~beaten).drop("around")


def scan(docs: DataFrame, signatures: Sequence[Rule] | None = None) -> DataFrame:
    """Licenses and notices in each row of ``docs(doc_id, text)``.

    A-Z are lowered and words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Returns
    ``doc_id``, ``n_words``, ``n_base`` (places where the words of a base phrase stand
    one after the other), ``first_word`` and ``last_word`` (their smallest and largest
    start, in words from 0; else null), ``base_labels``, ``labels`` (base ones and those
    of all detections that stand; both sorted and joined by commas) and ``score``
    (the largest confidence, 0 without any label).

    A null or empty text has no words, no labels and score 0. Repeated rows get
    equal results, rows that share a ``doc_id`` those of their own texts. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    rows = identified(docs.select("doc_id", "text"))
    found = _standing(_detections(_with_words(rows, "order", "copy"), rules() if signatures is None else signatures))
    labelled = found.groupBy("order", "copy").agg(
        F.collect_set("label").alias("own"), F.max("confidence").alias("confidence")
    )
    counted = _with_words(rows, "order", "copy", "row.doc_id")
    counted = counted.select("order", "copy", "doc_id", (_blanks(F.col("words")) - 1).alias("n_words"), *_base("words"))
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    sure = F.greatest(F.coalesce("confidence", F.lit(0.0)), F.when(F.size("base") > 0, BASE_CONFIDENCE).otherwise(0.0))
    return counted.join(labelled, ["order", "copy"], "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        sure.alias("score"),
    )
