"""SQL counterparts of the registered queries, for an independent engine.

Each statement states the wanted result from the given tables in plain SQL. The
order-to-cash collections are common table expressions.
"""

from __future__ import annotations

AS_OF = "DATE '1998-08-02'"

COLLECTIONS = """
lines AS (
  SELECT l_orderkey AS ok,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST, l_partkey NULLS FIRST,
           l_suppkey NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST, l_discount NULLS FIRST,
           l_tax NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_shipdate NULLS FIRST) AS ln,
         l_partkey AS partkey, l_suppkey AS suppkey, CAST(l_quantity AS DECIMAL(15,2)) AS qty,
         CAST(l_extendedprice AS DECIMAL(15,2)) AS amt, CAST(l_shipdate AS DATE) AS shipdate,
         l_linestatus AS ls, l_returnflag AS rf
  FROM lineitem),
billed AS (
  SELECT b.*, o_custkey AS custkey, o_orderstatus AS status
  FROM (SELECT ok, min(shipdate) AS billed_on, sum(amt) AS total, min(rf) = 'R' AS cancelled
        FROM lines WHERE rf IN ('N', 'R') GROUP BY ok) b
  JOIN orders ON o_orderkey = ok),
delivered AS (
  SELECT ok, min(suppkey) AS shipping_point, min(shipdate) AS shipped_on, max(rf) = 'A' AS pending
  FROM lines WHERE ls = 'O' GROUP BY ok),
sales_order_headers AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS salesorder, 'OR' AS salesordertype, CAST(o_custkey AS VARCHAR) AS soldtoparty,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T00:00:00.000Z' AS creationdate,
         CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR) AS totalnetamount, 'USD' AS transactioncurrency,
         o_orderstatus AS overalldeliverystatus, o_orderstatus AS overallordreltdbillgstatus
  FROM orders),
sales_order_items AS (
  SELECT CAST(ok AS VARCHAR) AS salesorder, CAST(ln * 10 AS VARCHAR) AS salesorderitem,
         CAST(partkey AS VARCHAR) AS material, CAST(qty AS VARCHAR) AS requestedquantity,
         'PC' AS requestedquantityunit, CAST(amt AS VARCHAR) AS netamount, 'USD' AS transactioncurrency,
         CAST(suppkey AS VARCHAR) AS productionplant
  FROM lines),
sales_order_schedule_lines AS (
  SELECT CAST(ok AS VARCHAR) AS salesorder, CAST(ln * 10 AS VARCHAR) AS salesorderitem, '1' AS scheduleline,
         CAST(shipdate AS VARCHAR) || 'T00:00:00.000Z' AS confirmeddeliverydate,
         CAST(qty AS VARCHAR) AS confdorderqtybymatlavailcheck
  FROM lines),
outbound_delivery_headers AS (
  SELECT CAST(80000000 + ok AS VARCHAR) AS deliverydocument,
         CAST(shipped_on AS VARCHAR) || 'T00:00:00.000Z' AS creationdate, CAST(NULL AS VARCHAR) AS creationtime,
         CASE WHEN NOT pending THEN CAST(shipped_on AS VARCHAR) || 'T00:00:00.000Z' END AS actualgoodsmovementdate,
         CAST(NULL AS VARCHAR) AS actualgoodsmovementtime,
         CASE WHEN pending THEN 'A' ELSE 'C' END AS overallgoodsmovementstatus,
         CAST(shipping_point AS VARCHAR) AS shippingpoint
  FROM delivered),
outbound_delivery_items AS (
  SELECT CAST(80000000 + ok AS VARCHAR) AS deliverydocument,
         lpad(CAST(ln * 10 AS VARCHAR), 6, '0') AS deliverydocumentitem, CAST(qty AS VARCHAR) AS actualdeliveryquantity,
         CAST(ok AS VARCHAR) AS referencesddocument, lpad(CAST(ln * 10 AS VARCHAR), 6, '0') AS referencesddocumentitem,
         CAST(suppkey AS VARCHAR) AS plant, CAST(NULL AS VARCHAR) AS storagelocation
  FROM lines WHERE ls = 'O'),
billing_document_headers AS (
  SELECT CAST(90000000 + ok AS VARCHAR) AS billingdocument, 'F2' AS billingdocumenttype,
         CAST(billed_on AS VARCHAR) || 'T00:00:00.000Z' AS creationdate,
         '{"hours":' || (ok % 24) || ',"minutes":' || (ok % 60) || ',"seconds":' || (custkey % 60) || '}' AS creationtime,
         CAST(billed_on AS VARCHAR) || 'T00:00:00.000Z' AS billingdocumentdate,
         cancelled AS billingdocumentiscancelled, CAST(total AS VARCHAR) AS totalnetamount,
         'USD' AS transactioncurrency, CAST(9400000000 + ok AS VARCHAR) AS accountingdocument,
         CAST(custkey AS VARCHAR) AS soldtoparty
  FROM billed),
billing_document_items AS (
  SELECT CAST(90000000 + ok AS VARCHAR) AS billingdocument, CAST(ln * 10 AS VARCHAR) AS billingdocumentitem,
         CAST(partkey AS VARCHAR) AS material, CAST(qty AS VARCHAR) AS billingquantity, CAST(amt AS VARCHAR) AS netamount,
         'USD' AS transactioncurrency, CAST(80000000 + ok AS VARCHAR) AS referencesddocument,
         CAST(ln * 10 AS VARCHAR) AS referencesddocumentitem
  FROM lines WHERE rf IN ('N', 'R')),
billing_document_cancellations AS (
  SELECT billingdocument, billingdocument AS cancelledbillingdocument, TRUE AS billingdocumentiscancelled
  FROM billing_document_headers WHERE billingdocumentiscancelled),
journal_entry_items_accounts_receivable AS (
  SELECT CAST(9400000000 + ok AS VARCHAR) AS accountingdocument, '1' AS accountingdocumentitem,
         CAST(90000000 + ok AS VARCHAR) AS referencedocument, CAST(custkey AS VARCHAR) AS customer,
         CAST(billed_on AS VARCHAR) || 'T00:00:00.000Z' AS postingdate,
         CAST(total AS VARCHAR) AS amountintransactioncurrency, 'USD' AS transactioncurrency,
         CAST(NULL AS VARCHAR) AS clearingdate
  FROM billed WHERE status <> 'O'),
payments_accounts_receivable AS (
  SELECT CAST(9500000000 + ok * 10 + k AS VARCHAR) AS accountingdocument, '1' AS accountingdocumentitem,
         CAST(custkey AS VARCHAR) AS customer,
         CAST(billed_on + CAST(ok % 45 + 1 AS INTEGER) AS VARCHAR) || 'T00:00:00.000Z' AS clearingdate,
         CAST(total AS VARCHAR) AS amountintransactioncurrency, 'USD' AS transactioncurrency,
         CAST(9400000000 + ok AS VARCHAR) AS clearingaccountingdocument
  FROM billed, (VALUES (0), (1)) copies(k) WHERE status = 'F' AND (k = 0 OR ok % 10 = 0)),
business_partners AS (
  SELECT CAST(c_custkey AS VARCHAR) AS businesspartner, c_name AS businesspartnerfullname,
         c_name AS businesspartnername, c_mktsegment AS businesspartnercategory
  FROM customer),
business_partner_addresses AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS addressid, CAST(c_custkey AS VARCHAR) AS businesspartner,
         CAST(NULL AS VARCHAR) AS streetname, n_name AS cityname, CAST(NULL AS VARCHAR) AS postalcode, r_name AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product, p_type AS producttype, p_brand AS productgroup, 'PC' AS baseunit
  FROM part),
product_descriptions AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product, 'EN' AS language, p_name AS productdescription FROM part),
plants AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS plant, s_name AS plantname, CAST(s_nationkey AS VARCHAR) AS addressid,
         CAST(NULL AS VARCHAR) AS plantcategory, CAST(NULL AS VARCHAR) AS factorycalendar,
         CAST(NULL AS VARCHAR) AS salesorganization, CAST(NULL AS VARCHAR) AS distributionchannel,
         CAST(NULL AS VARCHAR) AS division
  FROM supplier),
product_plants AS (
  SELECT DISTINCT CAST(partkey AS VARCHAR) AS product, CAST(suppkey AS VARCHAR) AS plant FROM lines),
product_storage_locations AS (
  SELECT DISTINCT CAST(partkey AS VARCHAR) AS product, CAST(suppkey AS VARCHAR) AS plant,
         'SL' || ls || rf AS storagelocation
  FROM lines),
customer_company_assignments AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer, '1000' AS companycode, CAST(NULL AS VARCHAR) AS paymentterms
  FROM customer),
customer_sales_area_assignments AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer, CAST(c_nationkey AS VARCHAR) AS salesorganization,
         '10' AS distributionchannel, '00' AS division, 'USD' AS currency
  FROM customer)
"""

# Column names by collection, with the ones that are keys first.
COLUMNS = {
    "sales_order_headers": (1, "salesorder salesordertype soldtoparty creationdate totalnetamount "
                               "transactioncurrency overalldeliverystatus overallordreltdbillgstatus"),
    "sales_order_items": (2, "salesorder salesorderitem material requestedquantity requestedquantityunit netamount "
                             "transactioncurrency productionplant"),
    "outbound_delivery_headers": (1, "deliverydocument creationdate creationtime actualgoodsmovementdate "
                                     "actualgoodsmovementtime overallgoodsmovementstatus shippingpoint"),
    "outbound_delivery_items": (2, "deliverydocument deliverydocumentitem actualdeliveryquantity "
                                   "referencesddocument referencesddocumentitem plant storagelocation"),
    "billing_document_headers": (1, "billingdocument billingdocumenttype creationdate creationtime "
                                    "billingdocumentdate billingdocumentiscancelled totalnetamount "
                                    "transactioncurrency accountingdocument soldtoparty"),
    "billing_document_items": (2, "billingdocument billingdocumentitem material billingquantity netamount "
                                  "transactioncurrency referencesddocument referencesddocumentitem"),
    "billing_document_cancellations": (2, "billingdocument cancelledbillingdocument billingdocumentiscancelled"),
    "journal_entry_items_accounts_receivable": (2, "accountingdocument accountingdocumentitem referencedocument "
                                                   "customer postingdate amountintransactioncurrency "
                                                   "transactioncurrency clearingdate"),
    "payments_accounts_receivable": (2, "accountingdocument accountingdocumentitem customer clearingdate "
                                        "amountintransactioncurrency transactioncurrency "
                                        "clearingaccountingdocument"),
    "business_partners": (1, "businesspartner businesspartnerfullname businesspartnername businesspartnercategory"),
    "business_partner_addresses": (1, "addressid businesspartner streetname cityname postalcode country"),
    "products": (1, "product producttype productgroup baseunit"),
    "product_descriptions": (2, "product language productdescription"),
    "plants": (1, "plant plantname addressid plantcategory factorycalendar salesorganization "
                  "distributionchannel division"),
    "product_plants": (2, "product plant"),
    "product_storage_locations": (3, "product plant storagelocation"),
    "customer_company_assignments": (2, "customer companycode paymentterms"),
    "customer_sales_area_assignments": (4, "customer salesorganization distributionchannel division currency"),
    "sales_order_schedule_lines": (3, "salesorder salesorderitem scheduleline confirmeddeliverydate "
                                      "confdorderqtybymatlavailcheck"),
}

CORE = [
    "sales_order_headers", "sales_order_items", "outbound_delivery_headers", "outbound_delivery_items",
    "billing_document_headers", "billing_document_items", "business_partners", "products", "plants",
    "journal_entry_items_accounts_receivable", "payments_accounts_receivable", "business_partner_addresses",
]
OPTIONAL = CORE[9:]
LOADED = ["sales_order_items", "outbound_delivery_items", "billing_document_items"]
# Tables that give one line each to a collection's files that loading must reject.
REJECTED = {
    "sales_order_headers": ("nation",), "outbound_delivery_headers": ("region",), "billing_document_headers": ("region",),
    "business_partners": ("nation", "region"), "products": ("region", "nation"), "plants": ("region",),
}


def _pad(column: str) -> str:
    return f"lpad(CAST({column} AS VARCHAR), 6, '0')"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _node(node_type: str, node_id: str, label: str, metadata: str, source: str) -> str:
    return (
        f"SELECT DISTINCT {node_id} AS node_id, '{node_type}' AS node_type, {label} AS label, "
        f"CAST(json_object({metadata}) AS VARCHAR) AS metadata_json FROM {source}"
    )


def _members(pairs: str) -> str:
    """``member=column`` pairs as arguments of json_object."""
    return ", ".join(f"'{p.partition('=')[0]}', {p.partition('=')[2]}" for p in pairs.split())


NODES = {
    "customer": _node(
        "Customer", "'customer_' || businesspartner",
        "coalesce(businesspartnerfullname, businesspartnername, businesspartner)",
        _members("businessPartner=businesspartner name=businesspartnerfullname category=businesspartnercategory"),
        "business_partners"),
    "address": _node(
        "Address", "'address_' || businesspartner || '_' || addressid", "coalesce(cityname, 'Address ' || addressid)",
        _members("business_partner=businesspartner address_id=addressid street=streetname city=cityname "
                 "postal_code=postalcode country=country"),
        "business_partner_addresses"),
    "sales_order": _node(
        "SalesOrder", "'salesorder_' || salesorder", "'Order ' || salesorder",
        _members("sales_order=salesorder type=salesordertype date=creationdate total_amount=totalnetamount "
                 "currency=transactioncurrency status=overalldeliverystatus customer=soldtoparty"),
        "sales_order_headers"),
    "sales_order_item": _node(
        "SalesOrderItem", f"'salesorderitem_' || salesorder || '_' || {_pad('salesorderitem')}",
        "'Item ' || salesorderitem",
        _members("sales_order=salesorder item=salesorderitem material=material quantity=requestedquantity "
                 "net_amount=netamount currency=transactioncurrency"),
        "sales_order_items"),
    "product": _node("Product", "'product_' || product", "product", _members("product=product"), "products"),
    "delivery": _node(
        "Delivery", "'delivery_' || deliverydocument", "'Delivery ' || deliverydocument",
        _members("deliveryDocument=deliverydocument shippingPoint=shippingpoint"), "outbound_delivery_headers"),
    "delivery_item": _node(
        "DeliveryItem", f"'deliveryitem_' || deliverydocument || '_' || {_pad('deliverydocumentitem')}",
        "'Item ' || deliverydocumentitem",
        _members("deliveryDocument=deliverydocument item=deliverydocumentitem "
                 "actualDeliveryQuantity=actualdeliveryquantity referenceSdDocument=referencesddocument "
                 "referenceSdDocumentItem=referencesddocumentitem plant=plant"),
        "outbound_delivery_items"),
    "plant": _node(
        "Plant", "'plant_' || plant", "coalesce(plantname, plant)",
        _members("plant=plant name=plantname address_id=addressid plantCategory=plantcategory "
                 "factoryCalendar=factorycalendar salesOrganization=salesorganization "
                 "distributionChannel=distributionchannel division=division"),
        "plants"),
    "billing_document": _node(
        "BillingDocument", "'billingdocument_' || billingdocument", "'Invoice ' || billingdocument",
        _members("billing_document=billingdocument type=billingdocumenttype date=billingdocumentdate "
                 "net_amount=totalnetamount currency=transactioncurrency is_cancelled=billingdocumentiscancelled "
                 "customer=soldtoparty accounting_document=accountingdocument"),
        "billing_document_headers"),
    "billing_item": _node(
        "BillingItem", f"'billingitem_' || billingdocument || '_' || {_pad('billingdocumentitem')}",
        "'Item ' || billingdocumentitem",
        _members("billing_document=billingdocument item=billingdocumentitem material=material net_amount=netamount "
                 "sales_order=referencesddocument sales_order_item=referencesddocumentitem"),
        "billing_document_items"),
    "journal_entry": _node(
        "JournalEntry", "'journalentry_' || accountingdocument || '_' || accountingdocumentitem",
        "'JE ' || accountingdocument",
        _members("accounting_document=accountingdocument item=accountingdocumentitem date=postingdate "
                 "amount=amountintransactioncurrency currency=transactioncurrency customer=customer"),
        "journal_entry_items_accounts_receivable"),
    "payment": _node(
        "Payment", "'payment_' || accountingdocument", "'Payment ' || accountingdocument",
        _members("accounting_document=accountingdocument clearing_date=clearingdate "
                 "amount=amountintransactioncurrency currency=transactioncurrency "
                 "clearing_accounting_document=clearingaccountingdocument"),
        "payments_accounts_receivable"),
}


def _edge(edge_type: str, edge_id: str, source: str, target: str, metadata: str, rows: str) -> str:
    return (
        f"SELECT DISTINCT '{edge_type.lower()}_' || {edge_id} AS edge_id, {source} AS source_id, "
        f"{target} AS target_id, '{edge_type}' AS edge_type, "
        f"CAST(json_object({metadata}) AS VARCHAR) AS metadata_json FROM {rows}"
    )


_SO_ITEM = f"s.salesorder || '_' || {_pad('s.salesorderitem')}"
_D_ITEM = f"d.deliverydocument || '_' || {_pad('d.deliverydocumentitem')}"
_B_ITEM = f"b.billingdocument || '_' || {_pad('b.billingdocumentitem')}"
_JE = "j.accountingdocument || '_' || j.accountingdocumentitem"
_BILLING_OF_DELIVERY = (
    "d.deliverydocument = b.referencesddocument "
    f"AND {_pad('d.deliverydocumentitem')} = {_pad('b.referencesddocumentitem')}"
)
_DELIVERY_OF_ORDER = (
    "s.salesorder = d.referencesddocument "
    f"AND {_pad('s.salesorderitem')} = {_pad('d.referencesddocumentitem')}"
)

EDGES = {
    "customer_placed_order": _edge(
        "CUSTOMER_PLACED_ORDER", "salesorder", "'customer_' || soldtoparty", "'salesorder_' || salesorder",
        "'relationship', 'customer_order'", "sales_order_headers WHERE soldtoparty IS NOT NULL"),
    "order_has_item": _edge(
        "ORDER_HAS_ITEM", _SO_ITEM, "'salesorder_' || s.salesorder", f"'salesorderitem_' || {_SO_ITEM}",
        "'quantity', s.requestedquantity", "sales_order_items s"),
    "item_for_product": _edge(
        "ITEM_FOR_PRODUCT", _SO_ITEM, f"'salesorderitem_' || {_SO_ITEM}", "'product_' || s.material",
        "'material', s.material", "sales_order_items s WHERE s.material IS NOT NULL"),
    "item_fulfilled_by_delivery_item": _edge(
        "ITEM_FULFILLED_BY_DELIVERY_ITEM", f"{_SO_ITEM} || '_' || {_D_ITEM}", f"'salesorderitem_' || {_SO_ITEM}",
        f"'deliveryitem_' || {_D_ITEM}",
        "'fulfilled_quantity', d.actualdeliveryquantity, 'delivery_document', d.deliverydocument",
        f"sales_order_items s JOIN outbound_delivery_items d ON {_DELIVERY_OF_ORDER}"),
    "delivery_item_in_delivery": _edge(
        "DELIVERY_ITEM_IN_DELIVERY", _D_ITEM, f"'deliveryitem_' || {_D_ITEM}", "'delivery_' || d.deliverydocument",
        "'relationship', 'parent_child'", "outbound_delivery_items d"),
    "delivery_item_from_plant": _edge(
        "DELIVERY_ITEM_FROM_PLANT", _D_ITEM, f"'deliveryitem_' || {_D_ITEM}", "'plant_' || d.plant",
        "'plant', d.plant", "outbound_delivery_items d WHERE d.plant IS NOT NULL"),
    "delivery_item_billed_by_billing_item": _edge(
        "DELIVERY_ITEM_BILLED_BY_BILLING_ITEM", f"{_D_ITEM} || '_' || {_B_ITEM}", f"'deliveryitem_' || {_D_ITEM}",
        f"'billingitem_' || {_B_ITEM}",
        "'billing_document', b.billingdocument, 'billed_quantity', b.billingquantity",
        f"outbound_delivery_items d JOIN billing_document_items b ON {_BILLING_OF_DELIVERY}"),
    "billing_item_in_document": _edge(
        "BILLING_ITEM_IN_DOCUMENT", _B_ITEM, f"'billingitem_' || {_B_ITEM}",
        "'billingdocument_' || b.billingdocument", "'relationship', 'parent_child'", "billing_document_items b"),
    "billing_document_posted_to_journal_entry": _edge(
        "BILLING_DOCUMENT_POSTED_TO_JOURNAL_ENTRY", f"h.billingdocument || '_' || {_JE}",
        "'billingdocument_' || h.billingdocument", f"'journalentry_' || {_JE}",
        "'accounting_document', j.accountingdocument, 'posted_amount', j.amountintransactioncurrency",
        "billing_document_headers h JOIN journal_entry_items_accounts_receivable j "
        "ON h.accountingdocument = j.accountingdocument"),
    "customer_has_address": _edge(
        "CUSTOMER_HAS_ADDRESS", "a.businesspartner || '_' || a.addressid", "'customer_' || a.businesspartner",
        "'address_' || a.businesspartner || '_' || a.addressid", "'address_id', a.addressid",
        "business_partner_addresses a JOIN business_partners p ON a.businesspartner = p.businesspartner"),
    "billing_document_for_customer": _edge(
        "BILLING_DOCUMENT_FOR_CUSTOMER", "billingdocument", "'billingdocument_' || billingdocument",
        "'customer_' || soldtoparty", "'customer', soldtoparty",
        "billing_document_headers WHERE soldtoparty IS NOT NULL"),
    "payment_clears_journal_entry": _edge(
        "PAYMENT_CLEARS_JOURNAL_ENTRY", f"p.accountingdocument || '_' || {_JE}", "'payment_' || p.accountingdocument",
        f"'journalentry_' || {_JE}",
        "'cleared_document', p.clearingaccountingdocument, 'clearing_date', p.clearingdate",
        "payments_accounts_receivable p JOIN journal_entry_items_accounts_receivable j "
        "ON p.clearingaccountingdocument = j.accountingdocument"),
}
BILLED_FOR = _edge(
    "BILLED_FOR", _B_ITEM, f"'billingitem_' || {_B_ITEM}", "'product_' || b.material", "'material', b.material",
    "billing_document_items b WHERE b.material IS NOT NULL")

ALL_NODES, ALL_EDGES = _union(list(NODES.values())), _union(list(EDGES.values()))
GRAPH = f"graph_nodes AS MATERIALIZED ({ALL_NODES}), graph_edges AS MATERIALIZED ({ALL_EDGES})"


def _count(table: str, alias: str = "rows") -> str:
    return f"SELECT '{table}' AS \"table\", count(*) AS {alias} FROM {table}"


NOT_BILLED = (
    "SELECT DISTINCT deliverydocument FROM outbound_delivery_items d WHERE NOT EXISTS "
    f"(SELECT 1 FROM billing_document_items b WHERE {_BILLING_OF_DELIVERY}) OR EXISTS "
    f"(SELECT 1 FROM billing_document_items b WHERE b.billingdocument IS NULL AND {_BILLING_OF_DELIVERY})"
)
NOT_DELIVERED = (
    "SELECT DISTINCT billingdocument FROM billing_document_items b WHERE NOT EXISTS "
    f"(SELECT 1 FROM outbound_delivery_items d WHERE {_BILLING_OF_DELIVERY}) OR EXISTS "
    f"(SELECT 1 FROM outbound_delivery_items d WHERE d.deliverydocument IS NULL AND {_BILLING_OF_DELIVERY})"
)
# An order is open if it has no items, or an item that no delivery item refers to; a reference from a row
# without a number doesn't count.
NO_DOWNSTREAM = (
    "SELECT DISTINCT salesorder FROM sales_order_headers h WHERE NOT EXISTS "
    "(SELECT 1 FROM sales_order_items s WHERE s.salesorder = h.salesorder) OR EXISTS "
    "(SELECT 1 FROM sales_order_items s LEFT JOIN outbound_delivery_items d "
    f"ON {_DELIVERY_OF_ORDER} WHERE s.salesorder = h.salesorder AND d.deliverydocument IS NULL)"
)
BUCKETS = {
    "delivered_but_not_billed": (NOT_BILLED, "deliverydocument", "delivery_"),
    "billed_without_delivery": (NOT_DELIVERED, "billingdocument", "billingdocument_"),
    "sales_orders_with_no_downstream_flow": (NO_DOWNSTREAM, "salesorder", "salesorder_"),
}


def _bucket_rows() -> str:
    return _union([
        f"SELECT {i} AS place, '{name}' AS bucket, {column} AS document, '{prefix}' || {column} AS node_id "
        f"FROM ({rows})"
        for i, (name, (rows, column, prefix)) in enumerate(BUCKETS.items())
    ])


FLOW_SUMMARY = f"""
found AS ({_bucket_rows()}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY document) AS n FROM found)
"""

RANKING = """
SELECT material AS product, count(DISTINCT billingdocument) AS billing_document_count
FROM billing_document_items WHERE material IS NOT NULL GROUP BY material
"""

# The trace of every billing document: one relation per kind of node and edge.
TRACE = f"""
traced AS (
  SELECT b.billingdocument AS doc, b.billingdocumentitem AS bitem, b.referencesddocument AS dd,
         b.referencesddocumentitem AS ditem, d.referencesddocument AS so, d.referencesddocumentitem AS sitem,
         b.billingdocument || '_' || {_pad('b.billingdocumentitem')} AS bkey,
         b.referencesddocument || '_' || {_pad('b.referencesddocumentitem')} AS dkey,
         d.referencesddocument || '_' || {_pad('d.referencesddocumentitem')} AS skey
  FROM billing_document_items b JOIN billing_document_headers h ON b.billingdocument = h.billingdocument
  LEFT JOIN outbound_delivery_items d ON {_BILLING_OF_DELIVERY}),
posted AS (
  SELECT h.billingdocument AS doc, j.accountingdocument AS ad, j.accountingdocumentitem AS item
  FROM billing_document_headers h JOIN journal_entry_items_accounts_receivable j
  ON h.accountingdocument = j.accountingdocument),
trace_nodes AS (
  SELECT billingdocument AS billing_document_id, 'billingdocument_' || billingdocument AS node_id,
         'BillingDocument' AS node_type, 'Invoice ' || billingdocument AS label,
         CAST(json_object('billingdocument', billingdocument, 'accountingdocument', accountingdocument,
                          'soldtoparty', soldtoparty) AS VARCHAR) AS metadata_json
  FROM billing_document_headers
  UNION SELECT billingdocument, 'customer_' || soldtoparty, 'Customer', soldtoparty,
         CAST(json_object('businesspartner', soldtoparty) AS VARCHAR)
  FROM billing_document_headers WHERE soldtoparty <> ''
  UNION SELECT doc, 'journalentry_' || ad || '_' || item, 'JournalEntry', 'JE ' || ad,
         CAST(json_object('accountingdocument', ad, 'accountingdocumentitem', item) AS VARCHAR) FROM posted
  UNION SELECT doc, 'billingitem_' || bkey, 'BillingItem', 'Item ' || bitem,
         CAST(json_object('billingdocument', doc, 'billingdocumentitem', bitem) AS VARCHAR) FROM traced
  UNION SELECT doc, 'delivery_' || dd, 'Delivery', 'Delivery ' || dd,
         CAST(json_object('deliverydocument', dd) AS VARCHAR) FROM traced WHERE dd <> ''
  UNION SELECT doc, 'deliveryitem_' || dkey, 'DeliveryItem', 'Item ' || ditem,
         CAST(json_object('deliverydocument', dd, 'deliverydocumentitem', ditem) AS VARCHAR)
  FROM traced WHERE dd <> ''
  UNION SELECT doc, 'salesorder_' || so, 'SalesOrder', 'Order ' || so,
         CAST(json_object('salesorder', so) AS VARCHAR) FROM traced WHERE so <> ''
  UNION SELECT doc, 'salesorderitem_' || skey, 'SalesOrderItem', 'Item ' || sitem,
         CAST(json_object('salesorder', so, 'salesorderitem', sitem) AS VARCHAR) FROM traced WHERE so <> ''),
trace_edges AS (
  SELECT billingdocument AS billing_document_id, 'billing_document_for_customer_' || billingdocument AS edge_id,
         'billingdocument_' || billingdocument AS source_id, 'customer_' || soldtoparty AS target_id,
         'BILLING_DOCUMENT_FOR_CUSTOMER' AS edge_type
  FROM billing_document_headers WHERE soldtoparty <> ''
  UNION SELECT doc, 'billing_document_posted_to_journal_entry_' || doc || '_' || ad || '_' || item,
         'billingdocument_' || doc, 'journalentry_' || ad || '_' || item,
         'BILLING_DOCUMENT_POSTED_TO_JOURNAL_ENTRY' FROM posted
  UNION SELECT doc, 'billing_item_in_document_' || bkey, 'billingitem_' || bkey, 'billingdocument_' || doc,
         'BILLING_ITEM_IN_DOCUMENT' FROM traced
  UNION SELECT doc, 'delivery_item_in_delivery_' || dkey, 'deliveryitem_' || dkey, 'delivery_' || dd,
         'DELIVERY_ITEM_IN_DELIVERY' FROM traced WHERE dd <> ''
  UNION SELECT doc, 'delivery_item_billed_by_billing_item_' || dkey || '_' || bkey, 'deliveryitem_' || dkey,
         'billingitem_' || bkey, 'DELIVERY_ITEM_BILLED_BY_BILLING_ITEM' FROM traced WHERE dd <> ''
  UNION SELECT doc, 'order_has_item_' || skey, 'salesorder_' || so, 'salesorderitem_' || skey,
         'ORDER_HAS_ITEM' FROM traced WHERE so <> ''
  UNION SELECT doc, 'item_fulfilled_by_delivery_item_' || skey || '_' || dkey, 'salesorderitem_' || skey,
         'deliveryitem_' || dkey, 'ITEM_FULFILLED_BY_DELIVERY_ITEM' FROM traced WHERE so <> '' AND dd <> '')
"""

TRACE_FACTS = """
SELECT billing_document_id, max(CASE WHEN node_type = 'Customer' THEN label END) AS customer,
       count(*) FILTER (node_type = 'BillingItem') AS billing_items,
       count(*) FILTER (node_type = 'DeliveryItem') AS delivery_items,
       count(*) FILTER (node_type = 'SalesOrderItem') AS sales_order_items,
       count(*) FILTER (node_type = 'JournalEntry') AS journal_entries
FROM trace_nodes GROUP BY billing_document_id
"""

JOINS = [
    ("sales_order_headers", ["salesOrder"], "sales_order_items", ["salesOrder"]),
    ("sales_order_items", ["salesOrder", "salesOrderItem"],
     "outbound_delivery_items", ["referenceSdDocument", "referenceSdDocumentItem"]),
    ("outbound_delivery_items", ["deliveryDocument", "deliveryDocumentItem"],
     "billing_document_items", ["referenceSdDocument", "referenceSdDocumentItem"]),
    ("billing_document_headers", ["accountingDocument"],
     "journal_entry_items_accounts_receivable", ["accountingDocument"]),
    ("journal_entry_items_accounts_receivable", ["accountingDocument"],
     "payments_accounts_receivable", ["clearingAccountingDocument"]),
    ("sales_order_headers", ["soldToParty"], "business_partners", ["businessPartner"]),
    ("sales_order_items", ["material"], "products", ["product"]),
    ("outbound_delivery_items", ["plant"], "plants", ["plant"]),
    ("business_partners", ["businessPartner"], "business_partner_addresses", ["businessPartner"]),
    ("plants", ["addressId"], "business_partner_addresses", ["addressId"]),
]


def _coverage(left: str, left_keys: list[str], right: str, right_keys: list[str]) -> str:
    def label(table: str, keys: list[str]) -> str:
        return f"{table}.{keys[0]}" if len(keys) == 1 else f"{table}.({', '.join(keys)})"

    def keys(table: str, names: list[str]) -> str:
        columns = ", ".join(
            f"CASE WHEN length(trim({n})) < 10 THEN lpad(trim({n}), 10, '0') ELSE trim({n}) END AS k{i}"
            for i, n in enumerate(names)
        )
        return f"SELECT DISTINCT {columns} FROM {table}"

    l, r = keys(left, left_keys), keys(right, right_keys)
    return f"""
SELECT '{label(left, left_keys)} -> {label(right, right_keys)}' AS join_path,
       (SELECT count(*) FROM {left}) AS left_count, (SELECT count(*) FROM {right}) AS right_count,
       (SELECT count(*) FROM ({l})) AS left_keys, (SELECT count(*) FROM ({r})) AS right_keys,
       (SELECT count(*) FROM ({l} INTERSECT {r})) AS matched,
       (SELECT count(*) FROM ({l} EXCEPT {r})) AS unmatched_left,
       (SELECT count(*) FROM ({r} EXCEPT {l})) AS unmatched_right"""


COVERAGE = f"""
SELECT *, round(matched / left_keys * 100, 2) AS coverage_pct,
       CASE WHEN matched / left_keys * 100 >= 95 THEN 'confirmed_with_normalization'
            WHEN matched / left_keys * 100 >= 80 THEN 'partial'
            WHEN matched / left_keys * 100 >= 50 THEN 'uncertain' ELSE 'not_recommended' END AS classification,
       '' AS issues
FROM ({_union([_coverage(*j) for j in JOINS])})
"""

def _cardinality(left: str, left_keys: list[str], right: str, right_keys: list[str]) -> str:
    def repeats(table: str, names: list[str]) -> str:
        keys = ", ".join(f"lpad(trim({n}), 10, '0')" for n in names)
        return f"(SELECT max(n) > 1 FROM (SELECT count(*) AS n FROM {table} GROUP BY {keys}))"

    condition = " AND ".join(f"{left}.{a} = {right}.{b}" for a, b in zip(left_keys, right_keys))
    l, r = repeats(left, left_keys), repeats(right, right_keys)
    return (
        f"SELECT '{left}' AS left_table, '{right}' AS right_table, '{condition}' AS condition, "
        f"CASE WHEN {l} AND {r} THEN 'N:M' WHEN {l} THEN 'N:1' WHEN {r} THEN '1:N' ELSE '1:1' END AS cardinality"
    )


KEY_PARTS = ("id", "key", "number", "document", "order")


def _column_rows(value: str) -> str:
    """One row per collection and column with ``value`` computed from ``{c}`` in ``{t}``."""
    parts = []
    for table, (_, names) in COLUMNS.items():
        for column in names.split():
            parts.append(value.format(t=table, c=column))
    return _union(parts)


def _schema_listing() -> str:
    parts = []
    for table, (n_keys, names) in COLUMNS.items():
        for i, column in enumerate(names.split()):
            kind = "boolean" if column == "billingdocumentiscancelled" else "string"
            parts.append(
                f"SELECT '{table}' AS collection, '{column}' AS \"column\", '{kind}' AS data_type, "
                f"{'TRUE' if i < n_keys else 'FALSE'} AS is_key, count(*) AS rows, "
                f"count({column}) < count(*) AS has_nulls FROM {table}"
            )
    return _union(parts)


def _distinct_values() -> str:
    parts = []
    for table, (_, names) in COLUMNS.items():
        for column in names.split():
            if any(part in column for part in KEY_PARTS):
                parts.append(
                    f"SELECT '{table}' AS collection, '{column}' AS \"column\", count(*) AS rows, "
                    f"count(DISTINCT coalesce(CAST({column} AS VARCHAR), 'None')) AS distinct_values FROM {table}"
                )
    return _union(parts)


COLUMN_FILLED = (
    "SELECT '{t}' AS collection, '{c}' AS col, count(*) AS rows, count({c}) AS filled FROM {t}"
)

MILESTONES = """
paid AS (
  SELECT clearingaccountingdocument AS ad, CAST(left(clearingdate, 10) AS DATE) AS paid_on
  FROM payments_accounts_receivable
  WHERE clearingaccountingdocument IN (SELECT accountingdocument FROM journal_entry_items_accounts_receivable)),
order_invoices AS (
  SELECT DISTINCT d.referencesddocument AS salesorder, b.billingdocument
  FROM outbound_delivery_items d JOIN billing_document_items b ON d.deliverydocument = b.referencesddocument),
milestones AS (
  SELECT o.salesorder, any_value(CAST(left(o.creationdate, 10) AS DATE)) AS created_on,
         min(CAST(left(h.billingdocumentdate, 10) AS DATE)) AS invoiced_on,
         min(p.paid_on) AS first_paid_on, max(p.paid_on) AS last_paid_on
  FROM sales_order_headers o LEFT JOIN order_invoices i ON o.salesorder = i.salesorder
  LEFT JOIN billing_document_headers h ON i.billingdocument = h.billingdocument
  LEFT JOIN paid p ON h.accountingdocument = p.ad
  GROUP BY o.salesorder),
order_paid AS (
  SELECT DISTINCT o.salesorder, p.paid_on, p.paid_on - CAST(left(o.creationdate, 10) AS DATE) AS o2c_days
  FROM sales_order_headers o JOIN sales_order_items s ON o.salesorder = s.salesorder
  JOIN order_invoices i ON o.salesorder = i.salesorder
  JOIN billing_document_headers h ON i.billingdocument = h.billingdocument
  JOIN paid p ON h.accountingdocument = p.ad)
"""

CANCELLED_IDS = "SELECT 'billingdocument_' || billingdocument FROM billing_document_cancellations"
ENDS = """
ends AS (
  SELECT source_id AS node_id, 'outgoing' AS direction, target_id AS neighbor_id, * FROM graph_edges
  UNION ALL SELECT target_id, 'incoming', source_id, * FROM graph_edges),
pairs AS (SELECT DISTINCT node_id, neighbor_id FROM ends)
"""
HOPS = """
seeds AS (SELECT node_id AS seed_id FROM graph_nodes WHERE node_type IN ({types})),
links AS (SELECT source_id AS a, target_id AS b FROM graph_edges UNION SELECT target_id, source_id FROM graph_edges),
hop1 AS (SELECT seed_id, seed_id AS node_id FROM seeds UNION SELECT seed_id, b FROM seeds JOIN links ON a = seed_id),
hop2 AS (SELECT * FROM hop1 UNION SELECT seed_id, b FROM hop1 JOIN links ON a = node_id),
hop3 AS (SELECT * FROM hop2 UNION SELECT seed_id, b FROM hop2 JOIN links ON a = node_id)
"""

EXAMPLE_PROMPTS = [
    "Which products are associated with the highest number of billing documents?",
    "Show me the top 5 products by billing count",
    "show me the top 5 products",
    "Show me all broken flows",
    "Trace billing document 90504248",
    "Trace a billing document",
    "trace invoice 90504248",
    "Explore the graph",
    "What's the weather today?",
    "Who won the Super Bowl?",
    "Tell me a joke",
    "hello",
    "",
]
IN_WORDS = (
    "product products material materials sku billing flow flows broken incomplete missing delivered billed delivery "
    "invoice document documents order orders count sales payment trace which what show list rank highest lowest top "
    "sales_order billing_document outbound_delivery journal_entry accounts_receivable outstanding overdue reconcile "
    "ledger downstream upstream lineage path connection"
).split()
OUT_WORDS = (
    "weather temperature rain sunny cloud forecast score game team player championship league match news headline "
    "breaking election war president movie music actor singer episode season capital population history author book "
    "poem joke funny laugh api rest function code programming python javascript stock crypto forex investment "
    "portfolio dividend"
).split()


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(_text(w) for w in words) + "]"


def _has(*phrases: str) -> str:
    return "(" + " OR ".join(f"contains(low, {_text(p)})" for p in phrases) + ")"


_EXAMPLES = ", ".join(f"('example-{i}', {_text(p)})" for i, p in enumerate(EXAMPLE_PROMPTS))
PROMPTS = f"""
prompts AS (
  SELECT 'said-' || conv_id || '-' || turn AS prompt_id, text AS prompt FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'trace-' || o_orderkey, 'Trace billing document ' || (90000000 + o_orderkey) FROM orders
  UNION ALL SELECT 'rank-' || p_partkey, 'List the top ' || p_size || ' products by billing' FROM part
  UNION ALL SELECT 'broken-' || c_custkey, 'Which orders of ' || c_mktsegment || ' are incomplete?' FROM customer
  UNION ALL SELECT * FROM (VALUES {_EXAMPLES}) examples(prompt_id, prompt)),
words AS (
  SELECT *, lower(prompt) AS low,
         [w FOR w IN list_distinct(regexp_split_to_array(
           regexp_replace(lower(prompt), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), ' +')) IF w <> ''] AS tokens
  FROM prompts),
checked AS (
  SELECT *, list_sort([w FOR w IN tokens IF list_contains({_list(OUT_WORDS)}, w)]) AS foreign_words,
         list_has_any(tokens, {_list(IN_WORDS)}) AS domestic
  FROM words),
guarded AS (
  SELECT *, len(foreign_words) = 0 AND domestic AS in_domain,
         CASE WHEN len(foreign_words) > 0
              THEN 'Query contains out-of-domain keywords: ' || array_to_string(foreign_words[1:3], ', ')
              WHEN domestic THEN 'Query contains in-domain keywords'
              WHEN len(tokens) > 0 THEN 'Query does not match known in-domain patterns'
              ELSE 'Empty query' END AS reason
  FROM checked),
found AS (
  SELECT *, nullif(regexp_extract(prompt, '(?:^|[^\\p{{L}}\\p{{N}}_])([0-9]{{8,}})(?:$|[^\\p{{L}}\\p{{N}}_])', 1), '') AS doc,
         nullif(regexp_extract(low, '(?:top|highest|first)\\s+([0-9]+)', 1), '') AS top_n,
         trim(prompt) = '' AS blank
  FROM guarded),
classified AS (
  SELECT *, CASE
      WHEN {_has("top product", "highest billing", "most billing", "which product", "products by billing")}
        THEN 'top_products'
      WHEN {_has("broken", "incomplete", "delivered not billed", "delivered but not billed",
                 "billed without delivery", "no downstream", "missing flow")} THEN 'broken_flows'
      WHEN {_has("trace billing", "trace document", "billing flow")} OR contains(low, 'trace ' || coalesce(doc, ''))
        THEN 'trace_billing_flow'
      WHEN {_has("explore", "show", "graph", "relationships", "connected")} THEN 'graph_explore'
      ELSE 'unknown' END AS asked
  FROM found),
routed AS (
  SELECT prompt_id, prompt, blank,
         CASE WHEN blank THEN 'unknown' WHEN NOT in_domain THEN 'out_of_domain' ELSE asked END AS intent,
         blank OR (in_domain AND (asked IN ('graph_explore', 'unknown')
                                  OR (asked = 'trace_billing_flow' AND doc IS NULL))) AS requires_clarification,
         CASE WHEN in_domain AND NOT blank AND asked = 'trace_billing_flow' THEN doc END AS billing_document_id,
         CASE WHEN in_domain AND NOT blank AND asked = 'top_products' THEN top_n END AS product_limit
  FROM classified)
"""

ANSWERS = f"""
, ranking AS ({RANKING}),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY billing_document_count DESC, product) AS place FROM ranking),
totals AS (
  SELECT (SELECT count(*) FROM ranking) AS products,
         (SELECT list(product ORDER BY place) FROM ranked WHERE place <= 10) AS best,
         (SELECT list('{{"product":"' || product || '","billing_document_count":' || billing_document_count || '}}'
                      ORDER BY place) FROM ranked WHERE place <= 50) AS best_rows,
         (SELECT billing_document_count FROM ranked WHERE place = 1) AS best_count),
flow_totals AS (
  SELECT count(*) FILTER (place = 0) AS n0, count(*) FILTER (place = 1) AS n1, count(*) FILTER (place = 2) AS n2,
         list(document ORDER BY place, n) FILTER (n <= 20) AS documents,
         list('"' || document || '"' ORDER BY n) FILTER (place = 0 AND n <= 20) AS s0,
         list('"' || document || '"' ORDER BY n) FILTER (place = 1 AND n <= 20) AS s1,
         list('"' || document || '"' ORDER BY n) FILTER (place = 2 AND n <= 20) AS s2,
         list(node_id ORDER BY place, n) FILTER (n <= 20) AS node_ids
  FROM numbered),
facts AS (
  SELECT f.*, (SELECT count(*) FROM trace_nodes n WHERE n.billing_document_id = f.billing_document_id) AS nodes,
         (SELECT count(*) FROM trace_edges e WHERE e.billing_document_id = f.billing_document_id) AS edges
  FROM ({TRACE_FACTS}) f),
joined AS (
  SELECT r.*, f.* EXCLUDE (billing_document_id), t.*, w.*,
         least(coalesce(CAST(product_limit AS BIGINT), 10), products) AS listed,
         r.intent = 'trace_billing_flow' AND r.billing_document_id IS NOT NULL AND f.billing_document_id IS NULL AS failed
  FROM routed r LEFT JOIN facts f ON r.billing_document_id = f.billing_document_id, totals t, flow_totals w)
SELECT prompt_id, CASE WHEN failed THEN 'error' ELSE intent END AS intent,
  CASE
    WHEN failed THEN 'An error occurred processing your query: trace query failed: Billing document '
                     || billing_document_id || ' not found.'
    WHEN intent = 'top_products' AND listed = 0 THEN 'No products found in the dataset.'
    WHEN intent = 'top_products' THEN 'The top product is ''' || best[1] || ''' with ' || best_count
         || ' billing documents. Here are the top ' || listed || ' products by billing document count.'
    WHEN intent = 'broken_flows' THEN 'Found ' || (n0 + n1 + n2) || ' broken flows in the O2C process:' || chr(10)
         || '- ' || n0 || ' deliveries not billed' || chr(10) || '- ' || n1 || ' billing docs without delivery'
         || chr(10) || '- ' || n2 || ' sales orders with no downstream flow'
    WHEN intent = 'trace_billing_flow' AND billing_document_id IS NULL
      THEN 'Which billing document would you like me to trace? Please provide a billing document ID.'
    WHEN intent = 'trace_billing_flow' THEN 'Traced billing document ' || billing_document_id || ':' || chr(10)
         || '- Customer: ' || coalesce(customer, 'N/A') || chr(10) || '- Billing Items: ' || billing_items || chr(10)
         || '- Delivery Items: ' || delivery_items || chr(10) || '- Sales Order Items: ' || sales_order_items || chr(10)
         || '- Posted to Journal Entry: ' || CASE WHEN journal_entries > 0 THEN 'Yes' ELSE 'No' END
    WHEN intent = 'graph_explore' THEN 'Graph exploration queries are not yet supported. Try asking about top '
         || 'products, broken flows, or trace a billing document.'
    WHEN intent = 'out_of_domain'
      THEN 'This system is designed to answer questions related to the provided dataset only.'
    WHEN blank THEN 'Please provide a question or query.'
    ELSE 'I''m not sure what you''re asking. Try asking about:' || chr(10)
         || '- Top products by billing document count' || chr(10) || '- Broken flows in the O2C process' || chr(10)
         || '- Trace a specific billing document (e.g., ''90504248'')' END AS answer_text,
  requires_clarification, CASE WHEN NOT failed THEN billing_document_id END AS billing_document_id,
  CASE WHEN intent = 'top_products' THEN coalesce(array_to_string(best[1:least(listed, 10)], ','), '')
       WHEN intent = 'broken_flows' THEN array_to_string(documents[1:50], ',') ELSE '' END AS cited_ids,
  CASE WHEN intent = 'top_products' THEN
         coalesce(array_to_string(['product_' || p FOR p IN best[1:least(listed, 10)]], ','), '')
       WHEN intent = 'broken_flows' THEN array_to_string(node_ids[1:50], ',') ELSE '' END AS cited_node_ids,
  CASE WHEN failed THEN '{{}}'
       WHEN intent = 'top_products' AND listed = 0 THEN '{{"count":0}}'
       WHEN intent = 'top_products' THEN '{{"limit":' || coalesce(CAST(product_limit AS HUGEINT), 10) || ',"results":['
            || coalesce(array_to_string(best_rows[1:least(listed, 50)], ','), '') || ']}}'
       WHEN intent = 'broken_flows' THEN '{{"delivered_but_not_billed":{{"count":' || n0 || ',"sample_ids":['
            || coalesce(array_to_string(s0, ','), '') || ']}},"billed_without_delivery":{{"count":' || n1
            || ',"sample_ids":[' || coalesce(array_to_string(s1, ','), '')
            || ']}},"sales_orders_with_no_downstream_flow":{{"count":' || n2 || ',"sample_ids":['
            || coalesce(array_to_string(s2, ','), '') || ']}}}}'
       WHEN intent = 'trace_billing_flow' AND billing_document_id IS NOT NULL
            THEN '{{"nodes":' || nodes || ',"edges":' || edges || '}}'
       ELSE '{{}}' END AS cited_data_summary
FROM joined
"""


def _first_record(table: str) -> str:
    columns = sorted(COLUMNS[table][1].split())
    members = ", ".join(f"'{c}', {c}" for c in columns)
    order = ", ".join(f"{c} NULLS LAST" for c in columns)
    return (
        f"(SELECT '{table}' AS collection, CAST(json_object({members}) AS VARCHAR) AS sample "
        f"FROM {table} ORDER BY {order} LIMIT 1)"
    )


def _id_report(table: str, id_column: str, type_column: str) -> str:
    return (
        f"SELECT {type_column}, count(*) AS rows, count(DISTINCT {id_column}) AS distinct_ids, "
        f"count(DISTINCT CASE WHEN n > 1 THEN {id_column} END) AS duplicated_ids, "
        f"count(*) FILTER ({id_column} IS NULL) AS missing_ids FROM "
        f"(SELECT *, count(*) OVER (PARTITION BY {id_column}) AS n FROM {table}) GROUP BY 1"
    )


# Bad lines by collection, one for each row of a table, and why they are rejected.
BAD_LINES = (
    ("sales_order_headers", "nation", "no record", "not one JSON object"),
    ("outbound_delivery_headers", "region", '["deliverydocument"]', "not one JSON object"),
    ("billing_document_headers", "region", '{"billingdocumentiscancelled": "maybe"}',
     "wrong value: billingdocumentiscancelled"),
    ("business_partners", "nation", '{"businesspartner": "x"} trailing', "not one JSON object"),
    ("business_partners", "region", "{}", "no members"),
    ("products", "region", "{'product': 'x'}", "not one JSON object"),
    ("products", "nation", '{"product": "x"}{"product": "y"}', "not one JSON object"),
    ("plants", "region", '{"plant": "x", "unknown": 1}', "unknown key: unknown"),
)


def statements() -> dict[str, str]:
    """SQL by query name."""
    plain: dict[str, str] = {}
    graph: dict[str, str] = {}

    # Loading
    graph["table_counts"] = _union([_count(t) for t in [*CORE, "graph_nodes", "graph_edges"]])
    plain["required_collections"] = _union([
        f"SELECT '{t}' AS collection, {'FALSE' if t in OPTIONAL else 'TRUE'} AS required, count(*) AS rows, "
        f"CASE WHEN count(*) > 0 THEN 'ok' ELSE '{'optional_missing' if t in OPTIONAL else 'missing'}' END AS status "
        f"FROM {t}" for t in CORE
    ])
    loaded = _union([
        f"SELECT '{t}' AS collection, count(*) AS inserted, "
        + " + ".join(["CAST(0 AS BIGINT)", *(f"(SELECT count(*) FROM {bad})" for bad in REJECTED.get(t, ()))])
        + f" AS errors, 4 AS files FROM {t}"
        for t in CORE
    ])
    plain["load_summary"] = plain["ingest_report"] = (
        "SELECT coalesce(collection, 'TOTAL') AS collection, CAST(sum(inserted) AS BIGINT) AS inserted, "
        "CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(files) AS BIGINT) AS files, "
        f"CASE WHEN sum(errors) > 0 THEN 'warning' ELSE 'ok' END AS status FROM ({loaded}) GROUP BY ROLLUP (collection)"
    )
    plain["ingested_items"] = f"SELECT {', '.join(COLUMNS['sales_order_items'][1].split())} FROM sales_order_items"
    plain["ingested_counts"] = _union([_count(t) for t in CORE])
    plain["resolved_paths"] = _union([
        f"SELECT '{t}' AS collection, '{asked}' AS asked, count(*) AS lines FROM {t}"
        for t in LOADED for asked in ("folder", "file")
    ])
    for table in LOADED:
        plain[f"load_{table}"] = f"SELECT {', '.join(COLUMNS[table][1].split())} FROM {table}"
    plain["normalized_item_keys"] = _union([
        f"SELECT '{t}' AS collection, {COLUMNS[t][1].split()[0]} || '_' || {_pad(COLUMNS[t][1].split()[1])} AS item_key "
        f"FROM {t}" for t in LOADED
    ])
    plain["schema_listing"] = _schema_listing()
    plain["typed_billing_headers"] = """
        SELECT billingdocument, CAST(totalnetamount AS DECIMAL(15,2)) AS total_net_amount,
               left(billingdocumentdate, 10) AS billed_on,
               left(creationdate, 10) || 'T' || clock || '.000Z' AS created_iso,
               CAST(left(creationdate, 10) || ' ' || clock AS TIMESTAMP) AS created_at
        FROM (SELECT *, lpad(creationtime->>'hours', 2, '0') || ':' || lpad(creationtime->>'minutes', 2, '0') || ':'
                     || lpad(creationtime->>'seconds', 2, '0') AS clock FROM billing_document_headers)"""
    graph["node_metadata_members"] = """
        SELECT node_type, member, count(*) AS nodes, count(metadata_json->>member) AS filled
        FROM (SELECT node_type, metadata_json, unnest(json_keys(metadata_json)) AS member FROM graph_nodes)
        GROUP BY 1, 2"""

    # Graph projection
    for name, sql in NODES.items():
        plain[f"nodes_{name}"] = sql
    for name, sql in EDGES.items():
        plain[f"edges_{name}"] = sql
    plain["edges_billed_for"] = BILLED_FOR
    plain["graph_nodes"], plain["graph_edges"] = ALL_NODES, ALL_EDGES
    graph["node_id_report"] = _id_report("graph_nodes", "node_id", "node_type")
    graph["edge_id_report"] = _id_report("graph_edges", "edge_id", "edge_type")
    all_ends = """(
          SELECT edge_id, edge_type, 'source' AS side, source_id AS missing_id FROM all_edges
          UNION ALL SELECT edge_id, edge_type, 'target', target_id FROM all_edges)"""
    graph["dangling_edges"] = f"""
        SELECT edge_id, edge_type, side AS "end", missing_id FROM {all_ends}
        WHERE missing_id NOT IN (SELECT node_id FROM graph_nodes)"""
    graph["dangling_counts"] = f"""
        SELECT edge_type, side AS "end", count(*) AS edges,
               count(*) FILTER (missing_id NOT IN (SELECT node_id FROM graph_nodes)) AS dangling
        FROM {all_ends} GROUP BY 1, 2"""
    plain["rejected_lines"] = _union([
        f"SELECT '{collection}' AS collection, {_text(line)} AS line, '{reason}' AS reason FROM {table}"
        for collection, table, line, reason in BAD_LINES
    ])
    graph["graph_sink"] = """
        SELECT node_type AS type, count(*) AS "count" FROM graph_nodes GROUP BY 1
        UNION ALL SELECT edge_type, count(*) FROM graph_edges GROUP BY 1"""
    plain["exported_products"] = f"SELECT format, r.* FROM ({RANKING}) r, (VALUES ('csv'), ('json')) kinds(format)"
    graph["graph_totals"] = _union([_count("graph_nodes"), _count("graph_edges")])

    # Graph queries
    graph["node_lookup"] = f"SELECT * FROM graph_nodes WHERE node_id IN ({CANCELLED_IDS})"
    graph["node_edges"] = "SELECT * FROM ends WHERE node_id IN (SELECT node_id FROM graph_nodes)"
    graph["node_related_counts"] = """
        SELECT p.node_id, n.node_type AS related_type, count(*) AS related
        FROM pairs p JOIN graph_nodes n ON n.node_id = p.neighbor_id
        WHERE p.node_id IN (SELECT node_id FROM graph_nodes) GROUP BY 1, 2"""
    graph["node_details_lead_times"] = """
        SELECT p.node_id, n.node_type AS related_type, count(*) AS related,
               any_value(invoiced_on - created_on) AS days_to_invoice,
               any_value(first_paid_on - invoiced_on) AS days_to_payment,
               any_value(first_paid_on - created_on) AS total_o2c_days
        FROM milestones m JOIN pairs p ON p.node_id = 'salesorder_' || m.salesorder
        JOIN graph_nodes n ON n.node_id = p.neighbor_id GROUP BY 1, 2"""
    graph["node_details"] = """
        SELECT p.node_id, p.neighbor_id, n.node_type AS neighbor_type, n.label AS neighbor_label,
               n.metadata_json AS neighbor_metadata, invoiced_on - created_on AS days_to_invoice,
               first_paid_on - invoiced_on AS days_to_payment, first_paid_on - created_on AS total_o2c_days
        FROM pairs p JOIN graph_nodes n ON n.node_id = p.neighbor_id
        JOIN graph_nodes o ON o.node_id = p.node_id AND o.node_type = 'SalesOrder'
        LEFT JOIN milestones m ON p.node_id = 'salesorder_' || m.salesorder"""
    graph["subgraph_nodes_depth_1"] = """
        SELECT s.seed_id, n.node_id, n.node_type, n.label
        FROM (SELECT node_id AS seed_id, node_id FROM graph_nodes UNION SELECT node_id, neighbor_id FROM pairs) s
        JOIN graph_nodes n ON n.node_id = s.node_id WHERE s.seed_id IN (SELECT node_id FROM graph_nodes)"""
    graph["subgraph_edges_depth_1"] = """
        SELECT DISTINCT node_id AS seed_id, edge_id, edge_type FROM ends
        WHERE node_id IN (SELECT node_id FROM graph_nodes)"""
    graph["subgraph_nodes_depth_2"] = "SELECT h.seed_id, n.* FROM hop2 h JOIN graph_nodes n ON n.node_id = h.node_id"
    graph["subgraph_edges_depth_2"] = """
        SELECT seed_id, e.* FROM hop1 JOIN graph_edges e ON e.source_id = node_id
        UNION SELECT seed_id, e.* FROM hop1 JOIN graph_edges e ON e.target_id = node_id"""
    graph["node_counts"] = "SELECT node_type, count(*) AS \"count\" FROM graph_nodes GROUP BY 1"
    graph["edge_counts"] = "SELECT edge_type, count(*) AS \"count\" FROM graph_edges GROUP BY 1"
    graph["graph_overview"] = """
        SELECT 'node' AS kind, coalesce(node_type, 'TOTAL') AS type, count(*) AS "count"
        FROM graph_nodes GROUP BY ROLLUP (node_type)
        UNION ALL SELECT 'edge', coalesce(edge_type, 'TOTAL'), count(*) FROM graph_edges GROUP BY ROLLUP (edge_type)"""
    graph["sample_nodes"] = "SELECT * FROM graph_nodes ORDER BY node_type, node_id LIMIT 5"
    graph["sample_edges"] = "SELECT * FROM graph_edges ORDER BY edge_type, edge_id LIMIT 5"
    batch = "CASE node_type WHEN 'Delivery' THEN 0 ELSE 1 END"
    seeds = f"SELECT node_id, {batch} AS batch FROM graph_nodes WHERE node_type IN ('Delivery', 'BillingDocument')"
    graph["merged_subgraph_nodes"] = f"""
        SELECT n.node_id, n.node_type, n.label, max(s.batch) AS batch
        FROM (SELECT * FROM ({seeds}) UNION ALL SELECT p.neighbor_id, s.batch FROM ({seeds}) s JOIN pairs p USING (node_id)) s
        JOIN graph_nodes n ON n.node_id = s.node_id GROUP BY 1, 2, 3"""
    graph["appended_subgraph_nodes"] = graph["merged_subgraph_nodes"]
    graph["merged_subgraph_edges"] = f"""
        SELECT e.edge_id, e.source_id, e.target_id, e.edge_type, max(s.batch) AS batch
        FROM ({seeds}) s JOIN ends e USING (node_id) GROUP BY 1, 2, 3, 4"""
    graph["subgraph_nodes_depth_3"] = """
        SELECT h.seed_id, n.node_id, n.node_type, n.label FROM hop3 h JOIN graph_nodes n ON n.node_id = h.node_id"""
    graph["highlighted_nodes"] = f"""
        SELECT node_id, node_type, node_id IN (SELECT 'delivery_' || deliverydocument FROM ({NOT_BILLED})) AS highlighted
        FROM graph_nodes"""
    graph["highlighted_edges"] = """
        SELECT edge_id, edge_type, edge_id IN (SELECT edge_id FROM trace_edges) AS highlighted FROM graph_edges"""
    graph["node_page"] = """
        SELECT *, (SELECT count(*) FROM graph_nodes WHERE node_type = 'SalesOrder') AS total
        FROM (SELECT * FROM graph_nodes WHERE node_type = 'SalesOrder' AND node_id > 'salesorder_12'
              ORDER BY node_id LIMIT 100)"""
    graph["edge_page"] = """
        SELECT *, (SELECT count(*) FROM typed_edges WHERE source_type = 'DeliveryItem') AS total
        FROM (SELECT * EXCLUDE (source_type) FROM typed_edges WHERE source_type = 'DeliveryItem'
              AND edge_id > 'delivery_item_from_plant_8' ORDER BY edge_id LIMIT 500)"""
    graph["filtered_edges"] = """
        SELECT edge_id, source_id, target_id, edge_type FROM typed_edges WHERE source_type = 'BillingDocument'"""
    # Of the graph these need a few types only.
    around = ("billing_item_in_document", "billing_document_posted_to_journal_entry", "billing_document_for_customer")
    plain["node_neighbors"] = f"""
        SELECT DISTINCT p.node_id, p.neighbor_id, n.node_type AS neighbor_type, n.label AS neighbor_label,
               n.metadata_json AS neighbor_metadata
        FROM (SELECT source_id AS node_id, target_id AS neighbor_id FROM ({_union([EDGES[e] for e in around])})
              UNION ALL
              SELECT target_id, source_id FROM ({_union([EDGES[e] for e in around])})) p
        JOIN ({_union([NODES[n] for n in ("billing_item", "journal_entry", "customer")])}) n ON n.node_id = p.neighbor_id
        WHERE p.node_id IN ({CANCELLED_IDS})
          AND p.node_id IN (SELECT 'billingdocument_' || billingdocument FROM billing_document_headers)"""
    to_product = f"""
        SELECT a.source_id AS node_0, a.target_id AS node_1, b.target_id AS node_2, c.target_id AS node_3
        FROM ({EDGES["customer_placed_order"]}) a JOIN ({EDGES["order_has_item"]}) b ON a.target_id = b.source_id
        JOIN ({EDGES["item_for_product"]}) c ON b.target_id = c.source_id
        WHERE a.source_id IN (SELECT 'customer_' || businesspartner FROM business_partners)"""
    plain["path_customer_to_product"] = to_product
    plain["path_counts_customer_to_product"] = f"""
        SELECT CAST(step AS INT) AS step, node_id, count(*) AS paths
        FROM (SELECT unnest([0, 1, 2, 3]) AS step, unnest([node_0, node_1, node_2, node_3]) AS node_id FROM ({to_product}))
        GROUP BY step, node_id"""
    plain["path_payment_to_customer"] = f"""
        SELECT a.source_id AS node_0, a.target_id AS node_1, b.source_id AS node_2, c.target_id AS node_3
        FROM ({EDGES["payment_clears_journal_entry"]}) a
        JOIN ({EDGES["billing_document_posted_to_journal_entry"]}) b ON a.target_id = b.target_id
        JOIN ({EDGES["billing_document_for_customer"]}) c ON b.source_id = c.source_id
        WHERE a.source_id IN (SELECT 'payment_' || accountingdocument FROM payments_accounts_receivable)"""
    plain["stored_node_edges"] = f"""
        SELECT e.target_id AS node_id, 'incoming' AS direction, e.source_id AS neighbor_id, e.*
        FROM ({EDGES["delivery_item_from_plant"]}) e
        WHERE e.target_id IN (SELECT 'plant_' || plant FROM plants ORDER BY plant LIMIT 5)"""

    # Flows and traces
    plain["top_products"] = f"{RANKING} ORDER BY billing_document_count DESC, product LIMIT 10"
    plain["products_by_billing"] = RANKING
    plain["delivered_not_billed"] = NOT_BILLED
    plain["billed_without_delivery"] = NOT_DELIVERED
    plain["orders_without_downstream"] = NO_DOWNSTREAM

    result = {name: f"WITH {COLLECTIONS}\n{sql}" for name, sql in plain.items()}
    result["broken_flow_summary"] = f"""WITH {COLLECTIONS}, {FLOW_SUMMARY}
        SELECT bucket, count(*) AS "count", string_agg(document, ',' ORDER BY n) FILTER (n <= 20) AS sample_ids
        FROM numbered GROUP BY bucket"""
    trace = f"WITH {COLLECTIONS}, {TRACE}"
    result["trace_nodes"] = f"{trace} SELECT * FROM trace_nodes"
    result["trace_edges"] = f"{trace} SELECT * FROM trace_edges"
    result["trace_summary"] = f"""{trace}
        SELECT n.billing_document_id, n.nodes, coalesce(e.edges, 0) AS edges
        FROM (SELECT billing_document_id, count(*) AS nodes FROM trace_nodes GROUP BY 1) n
        LEFT JOIN (SELECT billing_document_id, count(*) AS edges FROM trace_edges GROUP BY 1) e
        ON n.billing_document_id = e.billing_document_id"""
    result["trace_answer_facts"] = f"{trace} {TRACE_FACTS}"

    for name, sql in graph.items():
        extra = [GRAPH]
        if name.startswith(("node_edges", "node_neighbors", "node_related", "node_details", "merged", "appended")) or name.endswith(
            "depth_1"
        ):
            extra.append(ENDS)
        if name.startswith("node_details"):
            extra.append(MILESTONES)
        if name.endswith("depth_2"):
            extra.append(HOPS.format(types="'Plant', 'Address', 'Payment'"))
        if name.endswith("depth_3"):
            extra.append(HOPS.format(types="'Payment'"))
        if name == "highlighted_edges":
            extra.append(TRACE)
        if name.startswith("dangling"):
            extra.append(f"all_edges AS (SELECT * FROM graph_edges UNION ALL ({BILLED_FOR}))")
        if name in ("edge_page", "filtered_edges"):
            extra.append(
                "typed_edges AS (SELECT e.*, n.node_type AS source_type FROM graph_edges e "
                "JOIN graph_nodes n ON n.node_id = e.source_id)"
            )
        result[name] = f"WITH {COLLECTIONS}, {', '.join(extra)}\n{sql}"

    # Quality
    base = f"WITH {COLLECTIONS}\n"
    result["join_coverage"] = base + COVERAGE
    result["schema_joins"] = base + _union([_cardinality(*j) for j in JOINS])
    result["collection_profile"] = base + (
        "SELECT collection, max(rows) AS row_count, string_agg(col, ', ' ORDER BY col) AS columns "
        f"FROM ({_column_rows(COLUMN_FILLED)}) GROUP BY 1"
    )
    result["sample_records"] = base + _union([_first_record(t) for t in COLUMNS])
    result["column_distinct"] = base + _distinct_values()
    result["key_candidates"] = base + f"SELECT * FROM ({_distinct_values()}) WHERE distinct_values > rows * 0.8"
    result["shared_columns"] = base + (
        "SELECT col AS \"column\", string_agg(collection, ', ' ORDER BY collection) AS collections, "
        "count(*) AS appearances, CAST(sum(filled) AS BIGINT) AS filled_values "
        f"FROM ({_column_rows(COLUMN_FILLED)}) GROUP BY 1 HAVING count(*) > 1"
    )
    result["inventory"] = base + (
        "SELECT coalesce(collection, 'TOTAL') AS collection, CAST(sum(n) AS BIGINT) AS rows FROM ("
        + _union([f"SELECT '{t}' AS collection, count(*) AS n FROM {t}" for t in COLUMNS])
        + ") GROUP BY ROLLUP (collection)"
    )

    # Analytics
    money = "DECIMAL(38,2)"
    result["billing_by_product"] = base + f"""
        SELECT b.material, p.product, p.producttype, count(DISTINCT b.billingdocument) AS invoice_count,
               CAST(sum(CAST(b.netamount AS DECIMAL(15,2))) AS {money}) AS total_invoiced
        FROM billing_document_items b LEFT JOIN products p ON b.material = p.product GROUP BY 1, 2, 3"""
    result["invoice_lines"] = base + f"""
        SELECT h.billingdocument, b.billingdocumentitem, b.material, d.deliverydocument, d.deliverydocumentitem,
               d.referencesddocument AS salesorder, d.referencesddocumentitem AS salesorderitem, h.accountingdocument,
               CAST(b.netamount AS DECIMAL(15,2)) AS invoice_line_amount,
               CAST(h.totalnetamount AS DECIMAL(15,2)) AS invoice_total_amount, h.billingdocumentdate
        FROM billing_document_headers h JOIN billing_document_items b ON h.billingdocument = b.billingdocument
        LEFT JOIN outbound_delivery_items d ON {_BILLING_OF_DELIVERY}
        LEFT JOIN sales_order_items s ON {_DELIVERY_OF_ORDER}"""
    checks = {
        "orders_without_delivery": (
            "SELECT DISTINCT h.salesorder FROM sales_order_headers h LEFT JOIN outbound_delivery_items d "
            "ON h.salesorder = d.referencesddocument WHERE d.deliverydocument IS NULL"
        ),
        "deliveries_without_invoice": (
            "SELECT DISTINCT d.deliverydocument FROM outbound_delivery_items d LEFT JOIN billing_document_items b "
            "ON d.deliverydocument = b.referencesddocument WHERE b.billingdocument IS NULL"
        ),
        "invoices_without_payment": (
            "SELECT DISTINCT h.billingdocument FROM billing_document_headers h "
            "LEFT JOIN journal_entry_items_accounts_receivable j ON h.accountingdocument = j.accountingdocument "
            "LEFT JOIN payments_accounts_receivable p ON j.accountingdocument = p.clearingaccountingdocument "
            "WHERE p.clearingdate IS NULL"
        ),
    }
    for name, sql in checks.items():
        result[name] = base + sql
    result["incomplete_flow_counts"] = base + _union(
        [f"SELECT '{name}' AS \"check\", count(*) AS documents FROM ({sql})" for name, sql in checks.items()]
    )
    dated = f"WITH {COLLECTIONS}, {MILESTONES}\n"
    result["cycle_time_histogram"] = dated + """
        SELECT o2c_days, count(DISTINCT salesorder) AS order_count, min(o2c_days) AS min_days,
               max(o2c_days) AS max_days, avg(o2c_days) AS avg_days FROM order_paid GROUP BY 1"""
    result["cycle_time_summary"] = dated + """
        SELECT count(DISTINCT salesorder) AS order_count, min(o2c_days) AS min_days, max(o2c_days) AS max_days,
               round(avg(o2c_days), 4) AS avg_days FROM order_paid"""
    result["customer_payments"] = base + f"""
        SELECT p.customer, c.businesspartnerfullname AS customer_name,
               count(DISTINCT p.accountingdocument) AS payment_count,
               CAST(sum(CAST(p.amountintransactioncurrency AS DECIMAL(15,2))) AS {money}) AS total_paid,
               round(avg(CAST(left(p.clearingdate, 10) AS DATE) - j.posted_on), 4) AS avg_days_to_pay
        FROM payments_accounts_receivable p
        JOIN (SELECT accountingdocument, min(CAST(left(postingdate, 10) AS DATE)) AS posted_on
              FROM journal_entry_items_accounts_receivable GROUP BY 1) j
          ON p.clearingaccountingdocument = j.accountingdocument
        JOIN business_partners c ON p.customer = c.businesspartner GROUP BY 1, 2"""
    repeated = f"""
        SELECT clearingaccountingdocument, count(*) AS payment_count,
               CAST(sum(CAST(amountintransactioncurrency AS DECIMAL(15,2))) AS {money}) AS total_paid
        FROM payments_accounts_receivable GROUP BY 1 HAVING count(*) > 1"""
    result["duplicate_payments"] = base + repeated
    result["recent_duplicate_payments"] = base + f"""
        SELECT h.billingdocument, count(*) AS payment_count,
               CAST(sum(CAST(p.amountintransactioncurrency AS DECIMAL(15,2))) AS {money}) AS total_paid
        FROM billing_document_headers h
        JOIN payments_accounts_receivable p ON h.accountingdocument = p.clearingaccountingdocument
        WHERE CAST(left(h.billingdocumentdate, 10) AS DATE) >= {AS_OF} - 90 GROUP BY 1 HAVING count(*) > 1"""
    result["cancelled_impact"] = base + f"""
        SELECT count(DISTINCT c.billingdocument) AS cancelled_count,
               CAST(sum(CAST(h.totalnetamount AS DECIMAL(15,2))) AS {money}) AS cancelled_value
        FROM billing_document_cancellations c JOIN billing_document_headers h ON c.billingdocument = h.billingdocument"""
    result["plant_performance"] = base + f"""
        SELECT p.plant, p.plantname, count(DISTINCT d.deliverydocument) AS delivery_count,
               CAST(sum(CAST(d.actualdeliveryquantity AS DECIMAL(15,2))) AS {money}) AS total_qty_delivered,
               count(CASE WHEN h.overallgoodsmovementstatus = 'A' THEN 1 END) AS pending_deliveries
        FROM outbound_delivery_items d JOIN plants p ON d.plant = p.plant
        LEFT JOIN outbound_delivery_headers h ON d.deliverydocument = h.deliverydocument GROUP BY 1, 2"""
    result["active_invoices"] = base + """
        SELECT billingdocument, soldtoparty, CAST(totalnetamount AS DECIMAL(15,2)) AS total_net_amount,
               billingdocumentdate
        FROM billing_document_headers WHERE NOT billingdocumentiscancelled
          AND billingdocument NOT IN (SELECT billingdocument FROM billing_document_cancellations)"""
    result["slowest_orders"] = dated + f"""
        SELECT salesorder, coalesce(last_paid_on, {AS_OF}) - created_on AS o2c_days, last_paid_on IS NULL AS is_open
        FROM milestones WHERE month(created_on) = month({AS_OF}) AND year(created_on) = year({AS_OF})
        ORDER BY o2c_days DESC, salesorder LIMIT 5"""
    result["overdue_orders"] = base + f"""
        SELECT salesorder, left(creationdate, 10) AS created_on,
               {AS_OF} - CAST(left(creationdate, 10) AS DATE) AS age_days
        FROM sales_order_headers WHERE overalldeliverystatus <> 'F'
          AND {AS_OF} - CAST(left(creationdate, 10) AS DATE) > 30"""
    result["lead_times"] = dated + """
        SELECT salesorder, invoiced_on - created_on AS days_to_invoice, first_paid_on - invoiced_on AS days_to_payment,
               first_paid_on - created_on AS total_o2c_days FROM milestones"""
    result["product_plant_density"] = base + """
        SELECT pairs, products, plants, round(pairs / (products * plants) * 100, 4) AS density_pct
        FROM (SELECT (SELECT count(*) FROM product_plants) AS pairs, (SELECT count(*) FROM products) AS products,
                     (SELECT count(*) FROM plants) AS plants)"""
    result["storage_by_plant"] = base + """
        SELECT plant, count(*) AS storage_rows, count(DISTINCT product) AS products,
               count(DISTINCT storagelocation) AS storage_locations FROM product_storage_locations GROUP BY 1"""

    # Prompts
    result["prompt_guard"] = f"WITH {PROMPTS} SELECT prompt_id, in_domain, reason FROM guarded"
    result["prompt_intent"] = f"WITH {PROMPTS} SELECT * EXCLUDE (prompt, blank) FROM routed"
    everything = f"WITH {COLLECTIONS}, {TRACE}, {PROMPTS}"
    result["prompt_trace_references"] = f"""{everything}
        SELECT billing_document_id, 'node' AS kind, node_id AS ref_id FROM trace_nodes
        WHERE billing_document_id IN (SELECT billing_document_id FROM routed)
        UNION ALL SELECT billing_document_id, 'edge', edge_id FROM trace_edges
        WHERE billing_document_id IN (SELECT billing_document_id FROM routed)"""
    flow_ctes = FLOW_SUMMARY.replace("found AS", "flow_found AS").replace("FROM found", "FROM flow_found")
    result["prompt_answers"] = f"{everything}, {flow_ctes} {ANSWERS}"
    return result
