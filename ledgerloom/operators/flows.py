"""Flow reports: ranking of products and broken flows.

Broken flows compare the key sets of two large item tables. Where only the keys
matter, both sides are stacked and grouped by key once: that is one shuffle with
partial aggregation and no sort, and a key with very many rows arrives as few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import item6
from ledgerloom.session import stage
from ledgerloom.sources.catalog import Collections

DEFAULT_LIMIT = 10
SAMPLE_SIZE = 20

# Names of the broken-flow buckets, in report order.
DELIVERED_NOT_BILLED = "delivered_but_not_billed"
BILLED_WITHOUT_DELIVERY = "billed_without_delivery"
NO_DOWNSTREAM = "sales_orders_with_no_downstream_flow"
BUCKETS = (DELIVERED_NOT_BILLED, BILLED_WITHOUT_DELIVERY, NO_DOWNSTREAM)


def products_by_billing(tables: Collections) -> DataFrame:
    """Distinct billing documents per product."""
    items = tables["billing_document_items"].filter(F.col("material").isNotNull())
    return items.groupBy(F.col("material").alias("product")).agg(
        F.countDistinct("billingdocument").alias("billing_document_count")
    )


def top_products(tables: Collections, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The ``limit`` products on the most billing documents; ties by product."""
    ranked = products_by_billing(tables).orderBy(F.desc("billing_document_count"), F.asc("product"))
    return ranked.limit(limit)


def open_keys(left: DataFrame, right: DataFrame, keys: list[str], matched: Column) -> DataFrame:
    """Distinct keys of ``left`` for which a left join with ``right`` yields a row without match.

    A row of ``right`` matches only while ``matched`` is true of it; a key with
    one that does not stays open. Null keys never match.
    """
    on_right = right.dropna(subset=keys).select(*keys, F.lit(False).alias("wanted"), matched.alias("matched"))
    on_left = left.select(*keys, F.lit(True).alias("wanted"), F.lit(None).cast("boolean").alias("matched"))
    seen = on_left.unionByName(on_right).groupBy(*keys)
    flags = seen.agg(F.bool_or("wanted").alias("wanted"), F.bool_and("matched").alias("matched"))
    return flags.filter(F.col("wanted") & ~F.coalesce("matched", F.lit(False))).select(*keys)


def _delivery_keys(tables: Collections) -> DataFrame:
    return tables["outbound_delivery_items"].select(
        "deliverydocument", item6(F.col("deliverydocumentitem")).alias("delivery_item")
    )


def _billing_references(tables: Collections) -> DataFrame:
    return tables["billing_document_items"].select(
        "billingdocument",
        F.col("referencesddocument").alias("deliverydocument"),
        item6(F.col("referencesddocumentitem")).alias("delivery_item"),
    )


def delivered_not_billed(tables: Collections) -> DataFrame:
    """Deliveries with at least one item no billing item refers to."""
    unbilled = open_keys(
        _delivery_keys(tables),
        _billing_references(tables),
        ["deliverydocument", "delivery_item"],
        F.col("billingdocument").isNotNull(),
    )
    return unbilled.select("deliverydocument").distinct()


def billed_without_delivery(tables: Collections) -> DataFrame:
    """Billing documents with at least one item that refers to no delivery item.

    Items without a complete reference need no lookup, so they bypass the join
    instead of gathering on one null key.
    """
    keys = ["deliverydocument", "delivery_item"]
    references = _billing_references(tables)
    complete = F.col("deliverydocument").isNotNull() & F.col("delivery_item").isNotNull()
    dangling = references.filter(complete).join(_delivery_keys(tables).distinct(), keys, "left_anti")
    unreferenced = references.filter(~complete)
    return dangling.unionByName(unreferenced).select("billingdocument").distinct()


def orders_without_downstream(tables: Collections) -> DataFrame:
    """Sales orders with no items, or with at least one item that was not delivered."""
    ordered = tables["sales_order_items"].select(
        "salesorder", item6(F.col("salesorderitem")).alias("sales_item")
    )
    delivered = tables["outbound_delivery_items"].select(
        "deliverydocument",
        F.col("referencesddocument").alias("salesorder"),
        item6(F.col("referencesddocumentitem")).alias("sales_item"),
    )
    undelivered = open_keys(
        ordered, delivered, ["salesorder", "sales_item"], F.col("deliverydocument").isNotNull()
    )
    none = F.lit(False)
    header = tables["sales_order_headers"].select(
        "salesorder", F.lit(True).alias("header"), none.alias("items"), none.alias("open")
    )
    has_items = ordered.dropna(subset=["salesorder"]).select(
        "salesorder", none.alias("header"), F.lit(True).alias("items"), none.alias("open")
    )
    has_open = undelivered.dropna(subset=["salesorder"]).select(
        "salesorder", none.alias("header"), F.lit(True).alias("items"), F.lit(True).alias("open")
    )
    flags = (
        header.unionByName(has_items)
        .unionByName(has_open)
        .groupBy("salesorder")
        .agg(*[F.bool_or(c).alias(c) for c in ("header", "items", "open")])
    )
    return flags.filter(F.col("header") & (F.col("open") | ~F.col("items"))).select("salesorder")


def broken_flows(tables: Collections) -> DataFrame:
    """``(bucket, document)`` of all broken flows."""
    found = (delivered_not_billed(tables), billed_without_delivery(tables), orders_without_downstream(tables))
    parts = [
        ids.toDF("document").select(F.lit(name).alias("bucket"), "document") for name, ids in zip(BUCKETS, found)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def broken_flow_summary(tables: Collections, sample: int = SAMPLE_SIZE) -> DataFrame:
    """``(bucket, count, sample_ids)``: the sample is the first ids in ascending order.

    The documents are staged by bucket, since count and sample both read them.
    """
    found = stage(broken_flows(tables), "broken-flows", partition_by="bucket")
    parts = []
    for name in BUCKETS:
        ids = found.filter(F.col("bucket") == name)
        first = ids.orderBy(F.asc_nulls_last("document")).limit(sample)
        listed = first.agg(F.array_sort(F.collect_list("document")).alias("ids"))
        parts.append(
            ids.agg(F.count(F.lit(1)).alias("count")).select(
                F.lit(name).alias("bucket"), "count", listed.scalar().alias("sample_ids")
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
