"""From raw documents to packed training sequences.

``STAGES`` lists the stages in order. Each function takes ``(spark, docs, sf_dir)``
and works on all rows that the stage before it kept; all but the last return the
columns of ``documents``. ``run`` applies them to the documents of a folder and
writes and rereads what each stage returns, so that a lost executor costs a
re-read.

Every stage takes nulls in any column, empty and very long texts, further columns
with any name, which all but the last hand on, and tables without rows, which give
none. A null or empty text has no letter and goes at the first stage. A null
``doc_id`` counts as the largest. Of rows that share a ``doc_id`` those with different
texts are told apart; of equal ones near-dedup keeps one, and the stages behind it
would treat each alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontamination import find_leaks
from ledgerloom.llm.frames import table
from ledgerloom.llm.language_id import UNKNOWN, held_out, identify, learn
from ledgerloom.llm.near_copies import keep_one_of_both
from ledgerloom.llm.packing import pack
from ledgerloom.llm.substring_dedup import remove_repeated
from ledgerloom.session import stage

# A document whose likeliest language has a smaller share of its words is rejected.
LANGUAGE_SHARE = 0.4


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without any letter, and those that are no language for the most part."""
    model = learn(docs.filter(~held_out(F.col("doc_id"))))
    told = identify(docs, model)
    return told.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies, by SimHash prints and by shared shingles."""
    return keep_one_of_both(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words that already stand in a document with a smaller id; a document with no word left goes."""
    left = remove_repeated(docs).filter("n_removed = 0 or n_removed < n_words")
    return _rows(left, "kept")


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what benchmark windows cover; a document that is nothing else goes."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["after"] - x["first"])
    return _rows(found.filter((hit == 0) | (hit < F.col("n_words"))), "clean")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with the ids of all documents."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _rows(found: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with ``text`` in place of the text and its length where they have one."""
    row = found["row"].withField("text", found[text])
    if "n_chars" in found.schema["row"].dataType.names:
        row = row.withField("n_chars", F.char_length(found[text]).cast("long"))
    return found.select(row.alias("row")).select("row.*")


STAGES = [
    ("language id", keep_known_languages),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", cut_benchmark_passages),
    ("packing", pack_documents),
]

# Language, chains of near copies and packing can't be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
