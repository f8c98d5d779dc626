"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import extraction, nn_descent, quality
from ledgerloom.llm.chat_format import prefix_tree, read_back
from ledgerloom.llm.decontamination import find_leaks
from ledgerloom.llm.filter_audit import audit
from ledgerloom.llm.fingerprints import edited_neighbours
from ledgerloom.llm.frames import table
from ledgerloom.llm.hard_negatives import mine
from ledgerloom.llm.language_id import held_out, identify, learn
from ledgerloom.llm.license_scan import scan
from ledgerloom.llm.packing import pack
from ledgerloom.llm.simhash_dedup import near_duplicates
from ledgerloom.llm.substring_dedup import remove_repeated


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), one_space=True)
    return left.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    may_learn = ~held_out(F.col("doc_id"))
    network = quality.learn(documents.filter(may_learn), table(spark, sf_dir, "labels").filter(may_learn))
    return quality.score(documents, network).select(
        "row.doc_id",
        F.coalesce(held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# A conversation whose texts hold control strings of templates.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], given.schema)
    return read_back(prefix_tree(given.unionByName(odd), tokenizer), tokenizer)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    trees = extraction.learn(extraction.sample(pages))
    found = extraction.extract(pages, trees)
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.transform("items", lambda x: x.cast("string"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["after"] - x["first"])
    return find_leaks(documents, table(spark, sf_dir, "benchmark")).select(
        "row.doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = learn(documents.filter(~held_out(F.col("doc_id"))))
    return identify(documents.select("doc_id", "text"), model).select(
        "row.doc_id",
        F.coalesce(held_out(F.col("row.doc_id")), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings").filter(
        F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    anchor = F.col("vec_id") % 100 == 0
    return mine(given.select("vec_id", label.alias("label"), vector.alias("vector"), anchor.alias("anchor")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_packing": op3_packing,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_html_extraction": op5_html_extraction,
    "op6_license_scan": op6_license_scan,
    "op7_decontamination": op7_decontamination,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_language_id": op10_language_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
