"""Projection of the collections into a property graph.

Duplicates are removed on the source columns, before ids and metadata text are
built: a row with complete ids names all of them, so the result equals DISTINCT
over the finished rows while the shuffle carries only short columns. Rows whose
id lacks a part keep a null id for the checks to report. Edge joins
remove duplicates on the side that is unique by key first, so repeated rows
never multiply, and the final DISTINCT reuses the partitioning of the join.
Collections known to have no two rows with one key (``Collections.keyed``) need
no shuffle to be distinct.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import item6
from ledgerloom.functions.metadata import to_metadata
from ledgerloom.sources.catalog import Collections

NODE_COLUMNS = ("node_id", "node_type", "label", "metadata_json")
EDGE_COLUMNS = ("edge_id", "source_id", "target_id", "edge_type", "metadata_json")

UNDERSCORE = "_"


def join_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix_part_part``; null when a part is null."""
    pieces: list[Column] = [F.lit(prefix)]
    for part in parts:
        pieces += [F.lit(UNDERSCORE), F.col(part) if isinstance(part, str) else part]
    return F.concat(*pieces)


class NodeKind(NamedTuple):
    """How one collection becomes nodes; ``metadata`` maps members to columns."""

    collection: str
    node_id: Callable[[], Column]
    label: Callable[[], Column]
    metadata: Mapping[str, str]


def _prefixed(text: str, column: str) -> Callable[[], Column]:
    return lambda: F.concat(F.lit(f"{text} "), F.col(column))


# Node types, id prefixes, labels and metadata members.
NODE_KINDS: dict[str, NodeKind] = {
    "Customer": NodeKind(
        "business_partners",
        lambda: join_id("customer", "businesspartner"),
        lambda: F.coalesce("businesspartnerfullname", "businesspartnername", "businesspartner"),
        {
            "businessPartner": "businesspartner",
            "name": "businesspartnerfullname",
            "category": "businesspartnercategory",
        },
    ),
    "Address": NodeKind(
        "business_partner_addresses",
        lambda: join_id("address", "businesspartner", "addressid"),
        lambda: F.coalesce("cityname", F.concat(F.lit("Address "), F.col("addressid"))),
        {
            "business_partner": "businesspartner",
            "address_id": "addressid",
            "street": "streetname",
            "city": "cityname",
            "postal_code": "postalcode",
            "country": "country",
        },
    ),
    "SalesOrder": NodeKind(
        "sales_order_headers",
        lambda: join_id("salesorder", "salesorder"),
        _prefixed("Order", "salesorder"),
        {
            "sales_order": "salesorder",
            "type": "salesordertype",
            "date": "creationdate",
            "total_amount": "totalnetamount",
            "currency": "transactioncurrency",
            "status": "overalldeliverystatus",
            "customer": "soldtoparty",
        },
    ),
    "SalesOrderItem": NodeKind(
        "sales_order_items",
        lambda: join_id("salesorderitem", "salesorder", item6(F.col("salesorderitem"))),
        _prefixed("Item", "salesorderitem"),
        {
            "sales_order": "salesorder",
            "item": "salesorderitem",
            "material": "material",
            "quantity": "requestedquantity",
            "net_amount": "netamount",
            "currency": "transactioncurrency",
        },
    ),
    "Product": NodeKind(
        "products",
        lambda: join_id("product", "product"),
        lambda: F.col("product"),
        {"product": "product"},
    ),
    "Delivery": NodeKind(
        "outbound_delivery_headers",
        lambda: join_id("delivery", "deliverydocument"),
        _prefixed("Delivery", "deliverydocument"),
        {"deliveryDocument": "deliverydocument", "shippingPoint": "shippingpoint"},
    ),
    "DeliveryItem": NodeKind(
        "outbound_delivery_items",
        lambda: join_id("deliveryitem", "deliverydocument", item6(F.col("deliverydocumentitem"))),
        _prefixed("Item", "deliverydocumentitem"),
        {
            "deliveryDocument": "deliverydocument",
            "item": "deliverydocumentitem",
            "actualDeliveryQuantity": "actualdeliveryquantity",
            "referenceSdDocument": "referencesddocument",
            "referenceSdDocumentItem": "referencesddocumentitem",
            "plant": "plant",
        },
    ),
    "Plant": NodeKind(
        "plants",
        lambda: join_id("plant", "plant"),
        lambda: F.coalesce("plantname", "plant"),
        {
            "plant": "plant",
            "name": "plantname",
            "address_id": "addressid",
            "plantCategory": "plantcategory",
            "factoryCalendar": "factorycalendar",
            "salesOrganization": "salesorganization",
            "distributionChannel": "distributionchannel",
            "division": "division",
        },
    ),
    "BillingDocument": NodeKind(
        "billing_document_headers",
        lambda: join_id("billingdocument", "billingdocument"),
        _prefixed("Invoice", "billingdocument"),
        {
            "billing_document": "billingdocument",
            "type": "billingdocumenttype",
            "date": "billingdocumentdate",
            "net_amount": "totalnetamount",
            "currency": "transactioncurrency",
            "is_cancelled": "billingdocumentiscancelled",
            "customer": "soldtoparty",
            "accounting_document": "accountingdocument",
        },
    ),
    # The reference columns of a billing item hold its delivery; the member
    # names are kept because readers of the metadata rely on them.
    "BillingItem": NodeKind(
        "billing_document_items",
        lambda: join_id("billingitem", "billingdocument", item6(F.col("billingdocumentitem"))),
        _prefixed("Item", "billingdocumentitem"),
        {
            "billing_document": "billingdocument",
            "item": "billingdocumentitem",
            "material": "material",
            "net_amount": "netamount",
            "sales_order": "referencesddocument",
            "sales_order_item": "referencesddocumentitem",
        },
    ),
    "JournalEntry": NodeKind(
        "journal_entry_items_accounts_receivable",
        lambda: join_id("journalentry", "accountingdocument", "accountingdocumentitem"),
        _prefixed("JE", "accountingdocument"),
        {
            "accounting_document": "accountingdocument",
            "item": "accountingdocumentitem",
            "date": "postingdate",
            "amount": "amountintransactioncurrency",
            "currency": "transactioncurrency",
            "customer": "customer",
        },
    ),
    "Payment": NodeKind(
        "payments_accounts_receivable",
        lambda: join_id("payment", "accountingdocument"),
        _prefixed("Payment", "accountingdocument"),
        {
            "accounting_document": "accountingdocument",
            "clearing_date": "clearingdate",
            "amount": "amountintransactioncurrency",
            "currency": "transactioncurrency",
            "clearing_accounting_document": "clearingaccountingdocument",
        },
    ),
}

# Edge types with the node types they connect.
EDGE_ENDS: dict[str, tuple[str, str]] = {
    "CUSTOMER_PLACED_ORDER": ("Customer", "SalesOrder"),
    "ORDER_HAS_ITEM": ("SalesOrder", "SalesOrderItem"),
    "ITEM_FOR_PRODUCT": ("SalesOrderItem", "Product"),
    "ITEM_FULFILLED_BY_DELIVERY_ITEM": ("SalesOrderItem", "DeliveryItem"),
    "DELIVERY_ITEM_IN_DELIVERY": ("DeliveryItem", "Delivery"),
    "DELIVERY_ITEM_FROM_PLANT": ("DeliveryItem", "Plant"),
    "DELIVERY_ITEM_BILLED_BY_BILLING_ITEM": ("DeliveryItem", "BillingItem"),
    "BILLING_ITEM_IN_DOCUMENT": ("BillingItem", "BillingDocument"),
    "BILLING_DOCUMENT_POSTED_TO_JOURNAL_ENTRY": ("BillingDocument", "JournalEntry"),
    "CUSTOMER_HAS_ADDRESS": ("Customer", "Address"),
    "BILLING_DOCUMENT_FOR_CUSTOMER": ("BillingDocument", "Customer"),
    "PAYMENT_CLEARS_JOURNAL_ENTRY": ("Payment", "JournalEntry"),
}
BILLED_FOR = "BILLED_FOR"


# Edge types whose rows are told apart by the keys of these collections.
KEYED_BY: dict[str, tuple[str, ...]] = {
    "ORDER_HAS_ITEM": ("sales_order_items",),
    "ITEM_FOR_PRODUCT": ("sales_order_items",),
    "ITEM_FULFILLED_BY_DELIVERY_ITEM": ("sales_order_items", "outbound_delivery_items"),
    "DELIVERY_ITEM_IN_DELIVERY": ("outbound_delivery_items",),
    "DELIVERY_ITEM_FROM_PLANT": ("outbound_delivery_items",),
    "DELIVERY_ITEM_BILLED_BY_BILLING_ITEM": ("outbound_delivery_items", "billing_document_items"),
    "BILLING_ITEM_IN_DOCUMENT": ("billing_document_items",),
    BILLED_FOR: ("billing_document_items",),
}


Unique = Callable[[DataFrame], DataFrame]


def _as_they_are(rows: DataFrame) -> DataFrame:
    return rows


def _once(tables: Collections, names: tuple[str, ...], unique: Unique = DataFrame.distinct) -> Unique:
    """How to make rows with the keys of these collections ``unique``: known keys leave nothing to do."""
    return _as_they_are if tables.keyed(*names) else unique


def nodes_of_type(tables: Collections, node_type: str, unique: Unique = DataFrame.distinct) -> DataFrame:
    kind = NODE_KINDS[node_type]
    columns = list(kind.metadata.values())
    unique = _once(tables, (kind.collection,), unique)(tables[kind.collection].select(*columns, kind.label().alias("label")))
    return unique.select(
        kind.node_id().alias("node_id"),
        F.lit(node_type).alias("node_type"),
        "label",
        to_metadata({member: F.col(column) for member, column in kind.metadata.items()}).alias("metadata_json"),
    )


def build_nodes(tables: Collections) -> DataFrame:
    return reduce(DataFrame.unionByName, [nodes_of_type(tables, t) for t in NODE_KINDS])


def _edges(
    unique: DataFrame, edge_type: str, edge_id: Column, source: Column, target: Column, metadata: Mapping[str, Column]
) -> DataFrame:
    return unique.select(
        edge_id.alias("edge_id"),
        source.alias("source_id"),
        target.alias("target_id"),
        F.lit(edge_type).alias("edge_type"),
        to_metadata(metadata).alias("metadata_json"),
    )


def _sales_items(tables: Collections, *columns: str) -> DataFrame:
    return tables["sales_order_items"].select(
        "salesorder", item6(F.col("salesorderitem")).alias("sales_item"), *columns
    )


def _delivery_items(tables: Collections, *columns: Column | str) -> DataFrame:
    return tables["outbound_delivery_items"].select(
        "deliverydocument", item6(F.col("deliverydocumentitem")).alias("delivery_item"), *columns
    )


def _billing_items(tables: Collections, *columns: Column | str) -> DataFrame:
    return tables["billing_document_items"].select(
        "billingdocument", item6(F.col("billingdocumentitem")).alias("billing_item"), *columns
    )


def customer_placed_order(tables: Collections, unique: Unique = DataFrame.distinct) -> DataFrame:
    rows = tables["sales_order_headers"].filter(F.col("soldtoparty").isNotNull())
    return _edges(
        unique(rows.select("salesorder", "soldtoparty")),
        "CUSTOMER_PLACED_ORDER",
        join_id("customer_placed_order", "salesorder"),
        join_id("customer", "soldtoparty"),
        join_id("salesorder", "salesorder"),
        {"relationship": F.lit("customer_order")},
    )


def order_has_item(tables: Collections, unique: Unique = DataFrame.distinct) -> DataFrame:
    unique = _once(tables, KEYED_BY["ORDER_HAS_ITEM"], unique)
    return _edges(
        unique(_sales_items(tables, "requestedquantity")),
        "ORDER_HAS_ITEM",
        join_id("order_has_item", "salesorder", "sales_item"),
        join_id("salesorder", "salesorder"),
        join_id("salesorderitem", "salesorder", "sales_item"),
        {"quantity": F.col("requestedquantity")},
    )


def item_for_product(tables: Collections, unique: Unique = DataFrame.distinct) -> DataFrame:
    unique = _once(tables, KEYED_BY["ITEM_FOR_PRODUCT"], unique)
    return _edges(
        unique(_sales_items(tables, "material").filter(F.col("material").isNotNull())),
        "ITEM_FOR_PRODUCT",
        join_id("item_for_product", "salesorder", "sales_item"),
        join_id("salesorderitem", "salesorder", "sales_item"),
        join_id("product", "material"),
        {"material": F.col("material")},
    )


def item_fulfilled_by_delivery_item(tables: Collections, unique: Unique = DataFrame.distinct) -> DataFrame:
    unique = _once(tables, KEYED_BY["ITEM_FULFILLED_BY_DELIVERY_ITEM"], unique)
    ordered = _once(tables, ("sales_order_items",))(_sales_items(tables))
    delivered = _delivery_items(
        tables,
        "actualdeliveryquantity",
        F.col("referencesddocument").alias("salesorder"),
        item6(F.col("referencesddocumentitem")).alias("sales_item"),
    )
    return _edges(
        unique(ordered.join(delivered, ["salesorder", "sales_item"])),
        "ITEM_FULFILLED_BY_DELIVERY_ITEM",
        join_id(
            "item_fulfilled_by_delivery_item", "salesorder", "sales_item", "deliverydocument", "delivery_item"
        ),
        join_id("salesorderitem", "salesorder", "sales_item"),
        join_id("deliveryitem", "deliverydocument", "delivery_item"),
        {
            "fulfilled_quantity": F.col("actualdeliveryquantity"),
            "delivery_document": F.col("deliverydocument"),
        },
    )


def delivery_item_in_delivery(tables: Collections, unique: Unique = DataFrame.distinct) -> DataFrame:
    unique = _once(tables, KEYED_BY["DELIVERY_ITEM_IN_DELIVERY"], unique)
    return _edges(
        unique(_delivery_items(tables)),
        "DELIVERY_ITEM_IN_DELIVERY",
        join_id("delivery_item_in_delivery", "deliverydocument", "delivery_item"),
        join_id("deliveryitem", "deliverydocument", "delivery_item"),
        join_id("delivery", "deliverydocument"),
        {"relationship": F.lit("parent_child")},
    )


def delivery_item_from_plant(tables: Collections, unique: Unique = DataFrame.distinct) -> DataFrame:
    unique = _once(tables, KEYED_BY["DELIVERY_ITEM_FROM_PLANT"], unique)
    return _edges(
        unique(_delivery_items(tables, "plant").filter(F.col("plant").isNotNull())),
        "DELIVERY_ITEM_FROM_PLANT",
        join_id("delivery_item_from_plant", "deliverydocument", "delivery_item"),
        join_id("deliveryitem", "deliverydocument", "delivery_item"),
        join_id("plant", "plant"),
        {"plant": F.col("plant")},
    )


def delivery_item_billed_by_billing_item(tables: Collections, unique: Unique = DataFrame.distinct) -> DataFrame:
    unique = _once(tables, KEYED_BY["DELIVERY_ITEM_BILLED_BY_BILLING_ITEM"], unique)
    delivered = _once(tables, ("outbound_delivery_items",))(_delivery_items(tables))
    billed = _billing_items(
        tables,
        "billingquantity",
        F.col("referencesddocument").alias("deliverydocument"),
        item6(F.col("referencesddocumentitem")).alias("delivery_item"),
    )
    return _edges(
        unique(delivered.join(billed, ["deliverydocument", "delivery_item"])),
        "DELIVERY_ITEM_BILLED_BY_BILLING_ITEM",
        join_id(
            "delivery_item_billed_by_billing_item",
            "deliverydocument",
            "delivery_item",
            "billingdocument",
            "billing_item",
        ),
        join_id("deliveryitem", "deliverydocument", "delivery_item"),
        join_id("billingitem", "billingdocument", "billing_item"),
        {
            "billing_document": F.col("billingdocument"),
            "billed_quantity": F.col("billingquantity"),
        },
    )


def billing_item_in_document(tables: Collections, unique: Unique = DataFrame.distinct) -> DataFrame:
    unique = _once(tables, KEYED_BY["BILLING_ITEM_IN_DOCUMENT"], unique)
    return _edges(
        unique(_billing_items(tables)),
        "BILLING_ITEM_IN_DOCUMENT",
        join_id("billing_item_in_document", "billingdocument", "billing_item"),
        join_id("billingitem", "billingdocument", "billing_item"),
        join_id("billingdocument", "billingdocument"),
        {"relationship": F.lit("parent_child")},
    )


def billing_document_posted_to_journal_entry(tables: Collections, unique: Unique = DataFrame.distinct) -> DataFrame:
    documents = tables["billing_document_headers"].select("billingdocument", "accountingdocument")
    entries = tables["journal_entry_items_accounts_receivable"].select(
        "accountingdocument", "accountingdocumentitem", "amountintransactioncurrency"
    )
    return _edges(
        documents.distinct().join(entries.distinct(), "accountingdocument"),
        "BILLING_DOCUMENT_POSTED_TO_JOURNAL_ENTRY",
        join_id(
            "billing_document_posted_to_journal_entry",
            "billingdocument",
            "accountingdocument",
            "accountingdocumentitem",
        ),
        join_id("billingdocument", "billingdocument"),
        join_id("journalentry", "accountingdocument", "accountingdocumentitem"),
        {
            "accounting_document": F.col("accountingdocument"),
            "posted_amount": F.col("amountintransactioncurrency"),
        },
    )


def customer_has_address(tables: Collections, unique: Unique = DataFrame.distinct) -> DataFrame:
    addresses = tables["business_partner_addresses"].select("businesspartner", "addressid")
    partners = tables["business_partners"].select("businesspartner")
    return _edges(
        unique(addresses.join(partners, "businesspartner", "left_semi")),
        "CUSTOMER_HAS_ADDRESS",
        join_id("customer_has_address", "businesspartner", "addressid"),
        join_id("customer", "businesspartner"),
        join_id("address", "businesspartner", "addressid"),
        {"address_id": F.col("addressid")},
    )


def billing_document_for_customer(tables: Collections, unique: Unique = DataFrame.distinct) -> DataFrame:
    rows = tables["billing_document_headers"].filter(F.col("soldtoparty").isNotNull())
    return _edges(
        unique(rows.select("billingdocument", "soldtoparty")),
        "BILLING_DOCUMENT_FOR_CUSTOMER",
        join_id("billing_document_for_customer", "billingdocument"),
        join_id("billingdocument", "billingdocument"),
        join_id("customer", "soldtoparty"),
        {"customer": F.col("soldtoparty")},
    )


def payment_clears_journal_entry(tables: Collections, unique: Unique = DataFrame.distinct) -> DataFrame:
    payments = tables["payments_accounts_receivable"].select(
        F.col("accountingdocument").alias("payment"),
        F.col("clearingaccountingdocument").alias("accountingdocument"),
        "clearingdate",
    )
    entries = tables["journal_entry_items_accounts_receivable"].select(
        "accountingdocument", "accountingdocumentitem"
    )
    return _edges(
        payments.distinct().join(entries.distinct(), "accountingdocument"),
        "PAYMENT_CLEARS_JOURNAL_ENTRY",
        join_id("payment_clears_journal_entry", "payment", "accountingdocument", "accountingdocumentitem"),
        join_id("payment", "payment"),
        join_id("journalentry", "accountingdocument", "accountingdocumentitem"),
        {
            "cleared_document": F.col("accountingdocument"),
            "clearing_date": F.col("clearingdate"),
        },
    )


def billed_for(tables: Collections) -> DataFrame:
    """Billing item to product. Documented but not part of the built graph."""
    unique = _once(tables, KEYED_BY[BILLED_FOR])
    return _edges(
        unique(_billing_items(tables, "material").filter(F.col("material").isNotNull())),
        BILLED_FOR,
        join_id("billed_for", "billingdocument", "billing_item"),
        join_id("billingitem", "billingdocument", "billing_item"),
        join_id("product", "material"),
        {"material": F.col("material")},
    )


EDGE_BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "CUSTOMER_PLACED_ORDER": customer_placed_order,
    "ORDER_HAS_ITEM": order_has_item,
    "ITEM_FOR_PRODUCT": item_for_product,
    "ITEM_FULFILLED_BY_DELIVERY_ITEM": item_fulfilled_by_delivery_item,
    "DELIVERY_ITEM_IN_DELIVERY": delivery_item_in_delivery,
    "DELIVERY_ITEM_FROM_PLANT": delivery_item_from_plant,
    "DELIVERY_ITEM_BILLED_BY_BILLING_ITEM": delivery_item_billed_by_billing_item,
    "BILLING_ITEM_IN_DOCUMENT": billing_item_in_document,
    "BILLING_DOCUMENT_POSTED_TO_JOURNAL_ENTRY": billing_document_posted_to_journal_entry,
    "CUSTOMER_HAS_ADDRESS": customer_has_address,
    "BILLING_DOCUMENT_FOR_CUSTOMER": billing_document_for_customer,
    "PAYMENT_CLEARS_JOURNAL_ENTRY": payment_clears_journal_entry,
}


def edges_of_type(tables: Collections, edge_type: str, unique: Unique = DataFrame.distinct) -> DataFrame:
    return EDGE_BUILDERS[edge_type](tables, unique)


def build_edges(tables: Collections) -> DataFrame:
    return reduce(DataFrame.unionByName, [edges_of_type(tables, t) for t in EDGE_BUILDERS])


def build_links(tables: Collections) -> DataFrame:
    """``edge_type`` and the ends of all edges that have both, each pair of ids once.

    Types connect different pairs of node types, and the type of a node is in its id, so
    no pair occurs in two types, nor in both directions, and no id is linked to itself.
    """
    parts = []
    for edge_type in EDGE_BUILDERS:
        ends = edges_of_type(tables, edge_type, _as_they_are).select("edge_type", "source_id", "target_id").dropna()
        known = edge_type in KEYED_BY and tables.keyed(*KEYED_BY[edge_type])
        parts.append(ends if known else ends.distinct())
    return reduce(DataFrame.unionByName, parts)


def repeating(tables: Collections) -> tuple[DataFrame, DataFrame]:
    """The rows of :func:`build_nodes` and :func:`build_edges`, some of them more than once.

    For who makes ids distinct anyway: rows needn't be shuffled to be so first.
    """
    nodes = [nodes_of_type(tables, t, _as_they_are) for t in NODE_KINDS]
    edges = [edges_of_type(tables, t, _as_they_are) for t in EDGE_BUILDERS]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)
