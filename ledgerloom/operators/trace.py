"""Billing traces for any number of billing documents at once.

A trace lists the nodes and edges around a billing document: its customer and
journal entries, its items, the deliveries they refer to and the sales orders
behind those. Delivery nodes come from the reference of the billing item and
need no delivery; sales order nodes need a matching delivery item. So only the
sales order part joins items, and an inner join is enough.

Ids determine everything about an edge and most nodes, so plain DISTINCT removes
repeats. Only item nodes carry the item number as it is spelled; where one id
has several spellings, that of the first billing item counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property, reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import item6, present, spelled, trace_item
from ledgerloom.functions.metadata import to_metadata
from ledgerloom.operators.graph_build import join_id
from ledgerloom.sources.catalog import Collections

DOCUMENT = "billing_document_id"
NODE_FIELDS = ("node_id", "node_type", "label", "metadata_json")


def _known(tables: Collections, ids: DataFrame | None) -> DataFrame:
    headers = tables["billing_document_headers"].select(
        F.col("billingdocument").alias(DOCUMENT), "accountingdocument", "soldtoparty"
    )
    headers = headers.filter(F.col(DOCUMENT).isNotNull())
    return headers if ids is None else headers.join(ids.select(DOCUMENT), DOCUMENT, "left_semi")


def documents(tables: Collections, ids: DataFrame | None = None) -> DataFrame:
    """Headers to trace, one per document; ``ids(billing_document_id)`` limits them."""
    first = _known(tables, ids).groupBy(DOCUMENT).agg(F.min(F.struct("accountingdocument", "soldtoparty")).alias("header"))
    return first.select(DOCUMENT, "header.*")


def unknown_documents(tables: Collections, ids: DataFrame) -> DataFrame:
    """Requested ids without a billing document."""
    known = tables["billing_document_headers"].select(F.col("billingdocument").alias(DOCUMENT))
    return ids.select(DOCUMENT).distinct().join(known, DOCUMENT, "left_anti")


def _ids() -> SimpleNamespace:
    """Node ids and keys of a trace."""
    entry = [spelled(F.col("accountingdocument")), spelled(F.col("accountingdocumentitem"))]
    billing = [DOCUMENT, "billing_item"]
    delivery = ["deliverydocument", "delivery_item"]
    order = ["salesorder", "sales_item"]
    return SimpleNamespace(
        document=join_id("billingdocument", DOCUMENT),
        customer=join_id("customer", "soldtoparty"),
        entry_key=entry,
        entry=join_id("journalentry", *entry),
        billing_key=billing,
        billing_item=join_id("billingitem", *billing),
        delivery_key=delivery,
        delivery_item=join_id("deliveryitem", *delivery),
        order_key=order,
        order_item=join_id("salesorderitem", *order),
    )


def _text(prefix: str, column: str) -> Column:
    return F.concat(F.lit(f"{prefix} "), spelled(F.col(column)))


def _nodes(rows: DataFrame, node_id: Column, node_type: str, label: Column, metadata: Mapping[str, str]) -> DataFrame:
    return rows.select(
        DOCUMENT,
        node_id.alias("node_id"),
        F.lit(node_type).alias("node_type"),
        label.alias("label"),
        to_metadata({member: F.col(column) for member, column in metadata.items()}).alias("metadata_json"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _link(kind: str, *key: str) -> Column:
    """One fact about a document: a kind and up to four key columns."""
    columns = [F.col(key[i]) if i < len(key) else F.lit(None).cast("string") for i in range(4)]
    return F.struct(F.lit(kind).alias("kind"), *[c.alias(name) for c, name in zip(columns, "abcd")])


class Trace:
    """The plans of one batch of traces."""

    def __init__(self, tables: Collections, ids: DataFrame | None = None):
        self.tables = tables
        self.known = _known(tables, ids)
        self.headers = documents(tables, ids)
        self.customers = self.headers.filter(present(F.col("soldtoparty")))

    @cached_property
    def entries(self) -> DataFrame:
        entries = self.tables["journal_entry_items_accounts_receivable"].select(
            "accountingdocument", "accountingdocumentitem"
        )
        posted = self.headers.filter(present(F.col("accountingdocument")))
        return posted.join(entries.distinct(), "accountingdocument")

    @cached_property
    def items(self) -> DataFrame:
        """Billing items of the documents, with item numbers padded."""
        items = self.tables["billing_document_items"].select(
            F.col("billingdocument").alias(DOCUMENT),
            "billingdocumentitem",
            F.col("referencesddocument").alias("deliverydocument"),
            F.col("referencesddocumentitem").alias("deliverydocumentitem"),
        )
        return items.join(self.known.select(DOCUMENT), DOCUMENT, "left_semi").select(
            "*",
            trace_item(F.col("billingdocumentitem")).alias("billing_item"),
            trace_item(F.col("deliverydocumentitem")).alias("delivery_item"),
        )

    @cached_property
    def delivered(self) -> DataFrame:
        return self.items.filter(present(F.col("deliverydocument")))

    @cached_property
    def ordered(self) -> DataFrame:
        """Billing items with the sales order items their deliveries fulfil."""
        shipped = self.tables["outbound_delivery_items"].select(
            "deliverydocument",
            item6(F.col("deliverydocumentitem")).alias("match_item"),
            F.col("referencesddocument").alias("salesorder"),
            F.col("referencesddocumentitem").alias("salesorderitem"),
        )
        shipped = shipped.filter(present(F.col("salesorder"))).distinct()
        matchable = self.items.withColumn("match_item", item6(F.col("deliverydocumentitem")))
        return matchable.join(shipped, ["deliverydocument", "match_item"]).select(
            "*", trace_item(F.col("salesorderitem")).alias("sales_item")
        )

    def nodes(self) -> DataFrame:
        """``(billing_document_id, node_id, node_type, label, metadata_json)``."""
        ids = _ids()
        whole = [
            _nodes(
                self.headers,
                ids.document,
                "BillingDocument",
                _text("Invoice", DOCUMENT),
                {
                    "billingdocument": DOCUMENT,
                    "accountingdocument": "accountingdocument",
                    "soldtoparty": "soldtoparty",
                },
            ),
            _nodes(
                self.customers, ids.customer, "Customer", F.col("soldtoparty"), {"businesspartner": "soldtoparty"}
            ),
            _nodes(
                self.entries,
                ids.entry,
                "JournalEntry",
                _text("JE", "accountingdocument"),
                {"accountingdocument": "accountingdocument", "accountingdocumentitem": "accountingdocumentitem"},
            ),
            _nodes(
                self.delivered.select(DOCUMENT, "deliverydocument").distinct(),
                join_id("delivery", "deliverydocument"),
                "Delivery",
                _text("Delivery", "deliverydocument"),
                {"deliverydocument": "deliverydocument"},
            ),
            _nodes(
                self.ordered.select(DOCUMENT, "salesorder").distinct(),
                join_id("salesorder", "salesorder"),
                "SalesOrder",
                _text("Order", "salesorder"),
                {"salesorder": "salesorder"},
            ),
            _nodes(
                _first_spelling(self.items, ids.billing_key, "billingdocumentitem"),
                ids.billing_item,
                "BillingItem",
                _text("Item", "billingdocumentitem"),
                {"billingdocument": DOCUMENT, "billingdocumentitem": "billingdocumentitem"},
            ),
            _nodes(
                _first_spelling(self.delivered, [DOCUMENT, *ids.delivery_key], "deliverydocumentitem"),
                ids.delivery_item,
                "DeliveryItem",
                _text("Item", "deliverydocumentitem"),
                {"deliverydocument": "deliverydocument", "deliverydocumentitem": "deliverydocumentitem"},
            ),
            _nodes(
                _first_spelling(self.ordered, [DOCUMENT, *ids.order_key], "salesorderitem"),
                ids.order_item,
                "SalesOrderItem",
                _text("Item", "salesorderitem"),
                {"salesorder": "salesorder", "salesorderitem": "salesorderitem"},
            ),
        ]
        return _union(whole)

    def links(self, kinds: Sequence[str]) -> DataFrame:
        """Distinct facts from the items of each document, ``(billing_document_id, kind, a, b, c, d)``.

        Every base row is read once and gives its facts of all ``kinds``, as
        short keys; ids are built after repeats are gone.
        """
        parts = []
        of_items = [_link(kind, *key) for kind, key in ITEM_LINKS.items() if kind in kinds]
        if of_items:
            rows = self.items.select(DOCUMENT, F.inline(F.array(*of_items)))
            parts.append(rows.filter(present(F.col("a"))))
        of_orders = [_link(kind, *key) for kind, key in ORDER_LINKS.items() if kind in kinds]
        if of_orders:
            rows = self.ordered.select(DOCUMENT, F.inline(F.array(*of_orders)))
            parts.append(rows.filter((F.col("kind") != "fulfilled_by") | present(F.col("c"))))
        return _union(parts).distinct()

    def edges(self) -> DataFrame:
        """``(billing_document_id, edge_id, source_id, target_id, edge_type)``."""
        ids = _ids()
        own = self.customers.select(
            DOCUMENT,
            join_id("billing_document_for_customer", DOCUMENT).alias("edge_id"),
            ids.document.alias("source_id"),
            ids.customer.alias("target_id"),
            F.lit("BILLING_DOCUMENT_FOR_CUSTOMER").alias("edge_type"),
        )
        posted = self.entries.select(
            DOCUMENT,
            join_id("billing_document_posted_to_journal_entry", DOCUMENT, *ids.entry_key).alias("edge_id"),
            ids.document.alias("source_id"),
            ids.entry.alias("target_id"),
            F.lit("BILLING_DOCUMENT_POSTED_TO_JOURNAL_ENTRY").alias("edge_type"),
        )
        shapes = _edge_shapes()
        edge = F.lit(None)
        for kind, shape in shapes.items():
            edge = F.when(F.col("kind") == kind, shape).otherwise(edge)
        linked = self.links(list(shapes)).select(DOCUMENT, F.inline(F.array(edge)))
        return _union([own, posted, linked])

    def references(self) -> DataFrame:
        """``(billing_document_id, kind, ref_id)`` of all nodes and edges, where ``kind`` is node or edge.

        The same ids as in :meth:`nodes` and :meth:`edges`, from one pass over the facts.
        """
        ids = _ids()

        def refs(node: Column | None, edge: Column | None) -> Column:
            named = (("node", node), ("edge", edge))
            return F.array(
                *[F.struct(F.lit(k).alias("kind"), ref.alias("ref_id")) for k, ref in named if ref is not None]
            )

        customer_edge = join_id("billing_document_for_customer", DOCUMENT)
        entry_edge = join_id("billing_document_posted_to_journal_entry", DOCUMENT, *ids.entry_key)
        own = [
            self.headers.select(DOCUMENT, F.inline(refs(ids.document, None))),
            self.customers.select(DOCUMENT, F.inline(refs(ids.customer, customer_edge))),
            self.entries.select(DOCUMENT, F.inline(refs(ids.entry, entry_edge))),
        ]
        nodes, edges = _node_shapes(), _edge_shapes()
        found = F.lit(None)
        for kind in (*ITEM_LINKS, *ORDER_LINKS):
            edge = edges[kind].getField("edge_id") if kind in edges else None
            found = F.when(F.col("kind") == kind, refs(nodes.get(kind), edge)).otherwise(found)
        linked = self.links([*ITEM_LINKS, *ORDER_LINKS]).select(DOCUMENT, found.alias("refs"))
        return _union([*own, linked.select(DOCUMENT, F.inline("refs"))])

    def counts(self, kinds: Sequence[str]) -> DataFrame:
        """How often each of ``kinds`` occurs, per document."""
        own = {"documents": self.headers, "customers": self.customers, "journal_entries": self.entries}
        parts = [own[kind].select(DOCUMENT, F.lit(kind).alias("kind")) for kind in own if kind in kinds]
        parts.append(self.links([kind for kind in kinds if kind not in own]).select(DOCUMENT, "kind"))
        return _union(parts).groupBy(DOCUMENT).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])

    def summary(self) -> DataFrame:
        """Number of nodes and edges per document."""
        return self.counts(KINDS).select(DOCUMENT, *_sizes())


# Facts a billing item gives by itself, and with the delivery item it refers to:
# kind and key columns.
ITEM_LINKS = {
    "billing_items": ("billing_item",),
    "deliveries": ("deliverydocument",),
    "delivery_items": ("deliverydocument", "delivery_item"),
    "billed_by": ("deliverydocument", "delivery_item", "billing_item"),
}
ORDER_LINKS = {
    "sales_orders": ("salesorder",),
    "sales_order_items": ("salesorder", "sales_item"),
    "fulfilled_by": ("salesorder", "sales_item", "deliverydocument", "delivery_item"),
}

# What a trace counts per document. Nodes and edges of one kind correspond one to
# one, save for documents, deliveries and sales orders, which are nodes only, and
# the links between items, which are edges only.
NODE_KINDS = (
    "documents",
    "customers",
    "journal_entries",
    "billing_items",
    "deliveries",
    "delivery_items",
    "sales_orders",
    "sales_order_items",
)
EDGE_KINDS = (
    "customers",
    "journal_entries",
    "billing_items",
    "delivery_items",
    "sales_order_items",
    "billed_by",
    "fulfilled_by",
)
KINDS = tuple(dict.fromkeys(NODE_KINDS + EDGE_KINDS))


def _sizes() -> list[Column]:
    """Number of nodes and edges, from the counts of all kinds."""
    kinds = {"nodes": NODE_KINDS, "edges": EDGE_KINDS}
    return [reduce(Column.__add__, [F.col(kind) for kind in kinds[name]]).alias(name) for name in kinds]


def _edge(edge_type: str, edge_id: Column, source: Column, target: Column) -> Column:
    return F.struct(
        edge_id.alias("edge_id"),
        source.alias("source_id"),
        target.alias("target_id"),
        F.lit(edge_type).alias("edge_type"),
    )


def _node_shapes() -> dict[str, Column]:
    """Ids of the nodes that kinds of links stand for, from their key columns."""
    return {
        "billing_items": join_id("billingitem", DOCUMENT, "a"),
        "deliveries": join_id("delivery", "a"),
        "delivery_items": join_id("deliveryitem", "a", "b"),
        "sales_orders": join_id("salesorder", "a"),
        "sales_order_items": join_id("salesorderitem", "a", "b"),
    }


def _edge_shapes() -> dict[str, Column]:
    """How each kind of link reads as an edge, from its key columns."""
    return {
        "billing_items": _edge(
            "BILLING_ITEM_IN_DOCUMENT",
            join_id("billing_item_in_document", DOCUMENT, "a"),
            join_id("billingitem", DOCUMENT, "a"),
            join_id("billingdocument", DOCUMENT),
        ),
        "delivery_items": _edge(
            "DELIVERY_ITEM_IN_DELIVERY",
            join_id("delivery_item_in_delivery", "a", "b"),
            join_id("deliveryitem", "a", "b"),
            join_id("delivery", "a"),
        ),
        "billed_by": _edge(
            "DELIVERY_ITEM_BILLED_BY_BILLING_ITEM",
            join_id("delivery_item_billed_by_billing_item", "a", "b", DOCUMENT, "c"),
            join_id("deliveryitem", "a", "b"),
            join_id("billingitem", DOCUMENT, "c"),
        ),
        "sales_order_items": _edge(
            "ORDER_HAS_ITEM",
            join_id("order_has_item", "a", "b"),
            join_id("salesorder", "a"),
            join_id("salesorderitem", "a", "b"),
        ),
        "fulfilled_by": _edge(
            "ITEM_FULFILLED_BY_DELIVERY_ITEM",
            join_id("item_fulfilled_by_delivery_item", "a", "b", "c", "d"),
            join_id("salesorderitem", "a", "b"),
            join_id("deliveryitem", "c", "d"),
        ),
    }


def _first_spelling(rows: DataFrame, key: list[str], item: str) -> DataFrame:
    """One row per ``key`` with the ``item`` of its first billing item."""
    by = ["billingdocumentitem"] if item == "billingdocumentitem" else ["billingdocumentitem", item]
    unplaced = F.col("billingdocumentitem").isNull().alias("unplaced")
    first = rows.groupBy(*key).agg(F.min(F.struct(unplaced, *by)).alias("first"))
    return first.select(*key, F.col("first").getField(item).alias(item))


def trace_facts(tables: Collections, ids: DataFrame | None = None, sizes: bool = False) -> DataFrame:
    """What a written answer needs: the customer and the node counts per document.

    With ``sizes`` also what :meth:`Trace.summary` has, ``nodes`` and ``edges``, from the same pass.
    """
    trace = Trace(tables, ids)
    counted = ("billing_items", "delivery_items", "sales_order_items", "journal_entries")
    customers = trace.customers.select(DOCUMENT, F.col("soldtoparty").alias("customer"))
    found = trace.counts(KINDS if sizes else ("documents", *counted))
    more = _sizes() if sizes else []
    return found.join(customers, DOCUMENT, "left").select(DOCUMENT, "customer", *counted, *more)
