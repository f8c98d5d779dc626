"""Joins, broken flows and reports on messy data, against plain SQL and brute force."""

import datetime
import json

import duckdb
import pytest
from helpers import rows_of

from ledgerloom.operators import analytics, flows, graph_build, quality
from ledgerloom.operators.trace import DOCUMENT, Trace, trace_facts, unknown_documents
from ledgerloom.plans import oracle
from ledgerloom.sources.catalog import COLLECTIONS, declared_columns, declared_type


@pytest.fixture(scope="module")
def sql(messy_flow):
    rows, _ = messy_flow
    con = duckdb.connect()
    for name in COLLECTIONS:
        columns = declared_columns(name)
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {declared_type(c)}'.replace('string', 'VARCHAR') for c in columns)})")
        for row in rows.get(name, []):
            con.execute(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns))})", [row.get(c) for c in columns])

    def run(text, *columns):
        result = con.execute(f"SELECT {', '.join(columns) or '*'} FROM ({text})")
        return sorted(result.fetchall(), key=repr)

    return run


def complete(rows, required):
    return [r for r in rows if None not in r[:required]]


@pytest.mark.parametrize("node_type", list(graph_build.NODE_KINDS))
def test_nodes(messy_flow, sql, node_type):
    name = "".join(f"_{c.lower()}" if c.isupper() else c for c in node_type).lstrip("_")
    got = rows_of(graph_build.nodes_of_type(messy_flow[1], node_type), *graph_build.NODE_COLUMNS)
    expected = sql(oracle.NODES[name], *graph_build.NODE_COLUMNS)
    assert complete(got, 1) == complete(expected, 1)
    assert (len(complete(got, 1)) < len(got)) == (len(complete(expected, 1)) < len(expected))


@pytest.mark.parametrize("edge_type", list(graph_build.EDGE_BUILDERS))
def test_edges(messy_flow, sql, edge_type):
    got = rows_of(graph_build.edges_of_type(messy_flow[1], edge_type), *graph_build.EDGE_COLUMNS)
    expected = sql(oracle.EDGES[edge_type.lower()], *graph_build.EDGE_COLUMNS)
    assert complete(got, 3) == complete(expected, 3)
    assert (len(complete(got, 3)) < len(got)) == (len(complete(expected, 3)) < len(expected))


def test_billed_for(messy_flow, sql):
    got = rows_of(graph_build.billed_for(messy_flow[1]), *graph_build.EDGE_COLUMNS)
    assert complete(got, 3) == complete(sql(oracle.BILLED_FOR, *graph_build.EDGE_COLUMNS), 3)
    assert "BILLED_FOR" not in graph_build.EDGE_BUILDERS and len(graph_build.EDGE_BUILDERS) == 12


@pytest.mark.parametrize(
    "operator,text",
    [
        (flows.delivered_not_billed, oracle.NOT_BILLED),
        (flows.billed_without_delivery, oracle.NOT_DELIVERED),
        (flows.orders_without_downstream, oracle.NO_DOWNSTREAM),
        (flows.products_by_billing, oracle.RANKING),
    ],
)
def test_flows(messy_flow, sql, operator, text):
    got = operator(messy_flow[1])
    assert rows_of(got) == sql(text, *got.columns)


def test_top_products_order_and_limit(messy_flow, sql):
    expected = sorted(sql(oracle.RANKING, "product", "billing_document_count"), key=lambda r: (-r[1], r[0]))
    got = [tuple(r) for r in flows.top_products(messy_flow[1], 2).collect()]
    assert got == expected[:2] and any(r[0] == "" for r in expected)


def test_broken_flow_summary(messy_flow, sql):
    got = {r["bucket"]: (r["count"], r["sample_ids"]) for r in flows.broken_flow_summary(messy_flow[1], 2).collect()}
    assert list(got) == list(flows.BUCKETS)
    for name, (text, column, _) in oracle.BUCKETS.items():
        ids = [r[0] for r in sql(text, column)]
        known = sorted(i for i in ids if i is not None)
        assert got[name] == (len(ids), known[:2])


@pytest.mark.parametrize("name", ["orders_without_delivery", "deliveries_without_invoice", "invoices_without_payment"])
def test_header_level_checks(messy_flow, sql, name):
    text = oracle.statements()[name]
    text = text[text.index("SELECT DISTINCT", text.rindex("AS currency")) :]
    got = getattr(analytics, name)(messy_flow[1])
    column = got.columns[0]
    assert rows_of(got) == [r for r in sql(text, column) if r[0] is not None]


def expected_traces(rows):
    """Nodes and edges per document, walked row by row in item order."""
    pad6 = lambda v: None if v is None else v[:6].rjust(6, "0")
    traces = {}
    for head in rows["billing_document_headers"]:
        doc = head["billingdocument"]
        nodes, edges = {}, {}

        def node(node_id, kind, label, metadata):
            nodes.setdefault(node_id, (kind, label, tuple(metadata.items())))

        def edge(edge_id, source, target, kind):
            edges.setdefault(edge_id, (source, target, kind))

        root = f"billingdocument_{doc}"
        account, party = head["accountingdocument"], head["soldtoparty"]
        node(root, "BillingDocument", f"Invoice {doc}",
             {"billingdocument": doc, "accountingdocument": account, "soldtoparty": party})
        if party:
            node(f"customer_{party}", "Customer", party, {"businesspartner": party})
            edge(f"billing_document_for_customer_{doc}", root, f"customer_{party}", "BILLING_DOCUMENT_FOR_CUSTOMER")
        for entry in rows["journal_entry_items_accounts_receivable"]:
            if account and entry["accountingdocument"] == account:
                item = entry["accountingdocumentitem"]
                entry_id = f"journalentry_{account}_{item}"
                node(entry_id, "JournalEntry", f"JE {account}",
                     {"accountingdocument": account, "accountingdocumentitem": item})
                edge(f"billing_document_posted_to_journal_entry_{doc}_{account}_{item}", root, entry_id,
                     "BILLING_DOCUMENT_POSTED_TO_JOURNAL_ENTRY")
        matched = []
        for item in rows["billing_document_items"]:
            if item["billingdocument"] != doc:
                continue
            fits = [
                d for d in rows["outbound_delivery_items"]
                if d["deliverydocument"] is not None and d["deliverydocument"] == item["referencesddocument"]
                and pad6(d["deliverydocumentitem"]) is not None
                and pad6(d["deliverydocumentitem"]) == pad6(item["referencesddocumentitem"])
            ] or [{}]
            matched += [(item, d) for d in fits]
        text = lambda v: (v is None, v or "")
        # Within one billing item, a missing spelling sorts first.
        for item, delivered in sorted(matched, key=lambda m: (
            text(m[0]["billingdocumentitem"]),
            (m[0]["referencesddocumentitem"] is not None, m[0]["referencesddocumentitem"] or ""),
            (m[1].get("referencesddocumentitem") is not None, m[1].get("referencesddocumentitem") or ""),
        )):
            number = item["billingdocumentitem"]
            key = f"{doc}_{str(number).zfill(6)}"
            node(f"billingitem_{key}", "BillingItem", f"Item {number}",
                 {"billingdocument": doc, "billingdocumentitem": number})
            edge(f"billing_item_in_document_{key}", f"billingitem_{key}", root, "BILLING_ITEM_IN_DOCUMENT")
            delivery, ditem = item["referencesddocument"], item["referencesddocumentitem"]
            dkey = f"{delivery}_{str(ditem).zfill(6)}"
            if delivery:
                node(f"delivery_{delivery}", "Delivery", f"Delivery {delivery}", {"deliverydocument": delivery})
                node(f"deliveryitem_{dkey}", "DeliveryItem", f"Item {ditem}",
                     {"deliverydocument": delivery, "deliverydocumentitem": ditem})
                edge(f"delivery_item_in_delivery_{dkey}", f"deliveryitem_{dkey}", f"delivery_{delivery}",
                     "DELIVERY_ITEM_IN_DELIVERY")
                edge(f"delivery_item_billed_by_billing_item_{dkey}_{key}", f"deliveryitem_{dkey}",
                     f"billingitem_{key}", "DELIVERY_ITEM_BILLED_BY_BILLING_ITEM")
            order, sitem = delivered.get("referencesddocument"), delivered.get("referencesddocumentitem")
            if order:
                skey = f"{order}_{str(sitem).zfill(6)}"
                node(f"salesorder_{order}", "SalesOrder", f"Order {order}", {"salesorder": order})
                node(f"salesorderitem_{skey}", "SalesOrderItem", f"Item {sitem}",
                     {"salesorder": order, "salesorderitem": sitem})
                edge(f"order_has_item_{skey}", f"salesorder_{order}", f"salesorderitem_{skey}", "ORDER_HAS_ITEM")
                if delivery:
                    edge(f"item_fulfilled_by_delivery_item_{skey}_{dkey}", f"salesorderitem_{skey}",
                         f"deliveryitem_{dkey}", "ITEM_FULFILLED_BY_DELIVERY_ITEM")
        traces[doc] = nodes, edges
    return traces


def test_trace_matches_a_walk(messy_flow):
    rows, tables = messy_flow
    expected = expected_traces(rows)
    trace = Trace(tables)
    nodes, edges = {}, {}
    for r in trace.nodes().collect():
        assert (r[DOCUMENT], r["node_id"]) not in nodes
        nodes[r[DOCUMENT], r["node_id"]] = (
            r["node_type"], r["label"], tuple(json.loads(r["metadata_json"]).items()))
    for r in trace.edges().collect():
        assert (r[DOCUMENT], r["edge_id"]) not in edges
        edges[r[DOCUMENT], r["edge_id"]] = (r["source_id"], r["target_id"], r["edge_type"])
    ids_of = {k: v[0] for k, v in nodes.items()}
    assert ids_of == {(d, i): v[0] for d, (n, _) in expected.items() for i, v in n.items()}
    assert edges == {(d, i): v for d, (_, e) in expected.items() for i, v in e.items()}
    # Spellings may differ only where one billing item offers several.
    fixed = ("BillingDocument", "Customer", "JournalEntry", "Delivery", "SalesOrder", "BillingItem")
    for (doc, node_id), value in nodes.items():
        if value[0] in fixed:
            assert value == expected[doc][0][node_id]
    references = [(d, "node", i) for d, i in nodes] + [(d, "edge", i) for d, i in edges]
    assert rows_of(trace.references()) == sorted(references)
    assert rows_of(trace.summary()) == sorted(((d, len(n), len(e)) for d, (n, e) in expected.items()), key=repr)


def test_trace_of_some_documents(spark, messy_flow):
    tables = messy_flow[1]
    ids = spark.createDataFrame([("b2",), ("nope",), ("b2",)], f"{DOCUMENT} string")
    assert {r[DOCUMENT] for r in Trace(tables, ids).nodes().collect()} == {"b2"}
    assert {r[DOCUMENT] for r in Trace(tables, ids).edges().collect()} <= {"b2"}
    assert rows_of(unknown_documents(tables, ids)) == [("nope",)]
    facts = trace_facts(tables).filter(f"{DOCUMENT} = 'b4'").first().asDict()
    assert facts["billing_items"] == 0 and set(facts) == {
        DOCUMENT, "customer", "billing_items", "delivery_items", "sales_order_items", "journal_entries"}


def test_trace_spelling_of_first_item_wins(make_tables):
    tables = make_tables(
        billing_document_headers=[{"billingdocument": "b"}],
        billing_document_items=[
            {"billingdocument": "b", "billingdocumentitem": "20", "referencesddocument": "d",
             "referencesddocumentitem": "10"},
            {"billingdocument": "b", "billingdocumentitem": "10", "referencesddocument": "d",
             "referencesddocumentitem": "000010"},
        ],
    )
    labels = {r["node_id"]: r["label"] for r in Trace(tables).nodes().collect()}
    assert labels["deliveryitem_d_000010"] == "Item 000010"
    assert len(labels) == 5


def test_coverage(make_tables):
    tables = make_tables(
        sales_order_items=[{"salesorder": s, "salesorderitem": i} for s, i in
                           [("1", "10"), ("1", "10"), ("2", " 20 "), ("3", None), (None, "A")]],
        outbound_delivery_items=[{"referencesddocument": s, "referencesddocumentitem": i} for s, i in
                                 [("1", "000010"), ("0000000002", "20"), ("3", None), ("9", "9")]],
    )
    specs = [
        quality.JoinSpec("sales_order_items", ("salesOrder", "salesOrderItem"), "outbound_delivery_items",
                         ("referenceSdDocument", "referenceSdDocumentItem")),
        quality.JoinSpec("sales_order_items", ("salesOrder",), "outbound_delivery_items",
                         ("referenceSdDocument",), normalize=False),
        quality.JoinSpec("sales_order_items", ("material",), "products", ("product",)),
    ]
    got = {r["join_path"]: r for r in quality.join_coverage(tables, specs).collect()}
    pair, single, empty = (got[s.name].asDict() for s in specs)
    assert (pair["left_count"], pair["left_keys"], pair["right_keys"]) == (5, 4, 4)
    assert (pair["matched"], pair["unmatched_left"], pair["unmatched_right"]) == (3, 1, 1)
    assert (pair["coverage_pct"], pair["classification"]) == (75.0, "uncertain")
    assert (single["matched"], single["left_keys"], single["classification"]) == (2, 4, "uncertain")
    assert (empty["left_count"], empty["right_count"], empty["unmatched_left"]) == (5, 0, 5)
    assert (empty["coverage_pct"], empty["classification"], empty["issues"]) == (
        0.0, "not_recommended", "Missing collection data")


@pytest.mark.parametrize("matching,total,expected", [
    (95, 100, "confirmed_with_normalization"), (94, 100, "partial"), (80, 100, "partial"), (79, 100, "uncertain"),
    (50, 100, "uncertain"), (49, 100, "not_recommended"),
])
def test_coverage_classes(make_tables, matching, total, expected):
    tables = make_tables(
        sales_order_items=[{"material": f"m{i}"} for i in range(total)],
        products=[{"product": f"m{i}"} for i in range(matching)],
    )
    spec = quality.JoinSpec("sales_order_items", ("material",), "products", ("product",))
    assert quality.join_coverage(tables, [spec]).first()["classification"] == expected


def test_list_joins(make_tables):
    tables = make_tables(
        sales_order_headers=[{"salesorder": "1", "soldtoparty": "c"}, {"salesorder": "2", "soldtoparty": "c"}],
        sales_order_items=[{"salesorder": "1"}, {"salesorder": "01"}, {"salesorder": "2", "material": "m"}],
        business_partners=[{"businesspartner": "c"}],
    )
    got = {(r["left_table"], r["right_table"]): r for r in quality.list_joins(tables).collect()}
    assert got["sales_order_headers", "sales_order_items"]["cardinality"] == "1:N"
    assert got["sales_order_headers", "business_partners"]["cardinality"] == "N:1"
    assert got["outbound_delivery_items", "plants"]["cardinality"] == "1:1"
    assert got["sales_order_items", "outbound_delivery_items"]["condition"] == (
        "sales_order_items.salesOrder = outbound_delivery_items.referenceSdDocument AND "
        "sales_order_items.salesOrderItem = outbound_delivery_items.referenceSdDocumentItem")


def test_profiles(make_tables):
    tables = make_tables(
        plants=[{"plant": str(i), "addressid": "x" if i else None} for i in range(10)],
        products=[{"product": "p"}],
    )
    names = ["plants", "products"]
    profile = {r["collection"]: r for r in quality.collection_profile(tables, names).collect()}
    assert profile["plants"]["row_count"] == 10 and profile["plants"]["columns"].startswith("addressid, distribution")
    distinct = {(r["collection"], r["column"]): r["distinct_values"] for r in quality.column_distinct(tables, names).collect()}
    assert distinct == {("plants", "addressid"): 2}
    assert quality.key_candidates(tables, names).count() == 0
    assert rows_of(quality.inventory(tables, names)) == [("TOTAL", 11), ("plants", 10), ("products", 1)]
    shared = rows_of(quality.shared_columns(tables, ["products", "product_plants", "plants"]), "column", "collections")
    assert shared == [("plant", "plants, product_plants"), ("product", "product_plants, products")]
    samples = {r["collection"]: r["sample"] for r in quality.sample_records(tables, names).collect()}
    assert samples["products"] == '{"baseunit":null,"product":"p","productgroup":null,"producttype":null}'


@pytest.fixture(scope="module")
def small_flow(make_tables):
    return make_tables(
        sales_order_headers=[
            {"salesorder": "1", "creationdate": "2025-01-01", "overalldeliverystatus": "C"},
            {"salesorder": "2", "creationdate": "2025-01-05", "overalldeliverystatus": "A"},
            {"salesorder": "3", "creationdate": "2025-02-05", "overalldeliverystatus": None},
        ],
        sales_order_items=[{"salesorder": s, "salesorderitem": "10"} for s in "123"],
        outbound_delivery_items=[
            {"deliverydocument": "d1", "deliverydocumentitem": "10", "referencesddocument": "1", "plant": "p"},
            {"deliverydocument": "d1", "deliverydocumentitem": "20", "referencesddocument": "1", "plant": "p"},
            {"deliverydocument": "d2", "deliverydocumentitem": "10", "referencesddocument": "2", "plant": "q"},
        ],
        outbound_delivery_headers=[{"deliverydocument": "d1", "overallgoodsmovementstatus": "A"}],
        billing_document_items=[
            {"billingdocument": "b1", "referencesddocument": "d1", "netamount": "1.50", "material": "m"},
            {"billingdocument": "b2", "referencesddocument": "d1", "netamount": "2.25", "material": "m"},
        ],
        billing_document_headers=[
            {"billingdocument": "b1", "accountingdocument": "a1", "billingdocumentdate": "2025-01-04",
             "totalnetamount": "10.00", "billingdocumentiscancelled": False, "soldtoparty": "c"},
            {"billingdocument": "b2", "accountingdocument": "a2", "billingdocumentdate": "2024-01-08",
             "totalnetamount": "20.00", "billingdocumentiscancelled": None, "soldtoparty": "c"},
        ],
        billing_document_cancellations=[{"billingdocument": "b2"}, {"billingdocument": "b2"}],
        journal_entry_items_accounts_receivable=[
            {"accountingdocument": "a1", "accountingdocumentitem": "1", "postingdate": "2025-01-04"},
            {"accountingdocument": "a1", "accountingdocumentitem": "2", "postingdate": "2025-01-06"},
        ],
        payments_accounts_receivable=[
            {"accountingdocument": "x1", "customer": "c", "clearingdate": "2025-01-10",
             "amountintransactioncurrency": "5.00", "clearingaccountingdocument": "a1"},
            {"accountingdocument": "x2", "customer": "c", "clearingdate": "2025-01-20",
             "amountintransactioncurrency": "5.00", "clearingaccountingdocument": "a1"},
            {"accountingdocument": "x3", "customer": "c", "clearingdate": "2025-01-20",
             "amountintransactioncurrency": "7.00", "clearingaccountingdocument": "a7"},
        ],
        business_partners=[{"businesspartner": "c", "businesspartnerfullname": "Carol"}],
        plants=[{"plant": "p", "plantname": "P"}],
        products=[{"product": "m", "producttype": "t"}, {"product": "n"}],
        product_plants=[{"product": "m", "plant": "p"}, {"product": "m", "plant": "p"}],
        product_storage_locations=[{"product": "m", "plant": "p", "storagelocation": s} for s in "xyy"],
    )


def test_reports(small_flow):
    as_of = datetime.date(2025, 3, 1)
    money = lambda rows: [tuple(str(v) for v in r) for r in rows]
    assert rows_of(analytics.cycle_time_histogram(small_flow)) == [(19, 1, 19, 19, 19.0), (9, 1, 9, 9, 9.0)]
    assert rows_of(analytics.cycle_time_summary(small_flow)) == [(1, 9, 19, 14.0)]
    assert money(rows_of(analytics.customer_payments(small_flow))) == [("c", "Carol", "2", "10.00", "11.0")]
    assert money(rows_of(analytics.duplicate_payments(small_flow))) == [("a1", "2", "10.00")]
    assert money(rows_of(analytics.recent_duplicate_payments(small_flow, as_of))) == [("b1", "2", "10.00")]
    assert rows_of(analytics.recent_duplicate_payments(small_flow, as_of, days=10)) == []
    assert money(rows_of(analytics.cancelled_impact(small_flow))) == [("1", "20.00")]
    assert rows_of(analytics.plant_performance(small_flow), "plant", "delivery_count", "pending_deliveries") == [("p", 1, 2)]
    assert [r[0] for r in rows_of(analytics.active_invoices(small_flow))] == ["b1"]
    january = datetime.date(2025, 1, 31)
    assert [tuple(r) for r in analytics.slowest_orders(small_flow, january).collect()] == [("2", 26, True), ("1", 19, False)]
    assert [r[0] for r in rows_of(analytics.overdue_orders(small_flow, as_of))] == ["2"]
    assert rows_of(analytics.lead_times(small_flow)) == [
        ("1", -359, 368, 9), ("2", None, None, None), ("3", None, None, None)]
    assert rows_of(analytics.product_plant_density(small_flow)) == [(1, 2, 1, 50.0)]
    assert rows_of(analytics.storage_by_plant(small_flow)) == [("p", 3, 1, 2)]
    assert money(rows_of(analytics.billing_by_product(small_flow, 5))) == [("m", "m", "t", "2", "3.75")]
    assert rows_of(analytics.incomplete_flow_counts(small_flow)) == [
        ("deliveries_without_invoice", 1), ("invoices_without_payment", 1), ("orders_without_delivery", 1)]


def test_histogram_of_nothing(make_tables):
    assert analytics.cycle_time_histogram(make_tables()).count() == 0
    assert flows.top_products(make_tables()).count() == 0


def test_full_sketches_are_counted_exactly(make_tables, monkeypatch):
    """Few, many and mostly distinct values; what a sketch can't hold is shuffled, and only that."""
    rows = [
        {"salesorder": str(i), "salesorderitem": str(i % 7), "material": "m", "productionplant": None} for i in range(9000)
    ] + [{"salesorder": None}] * 3
    tables = make_tables(sales_order_items=rows, sales_order_headers=[])
    names = ["sales_order_items", "sales_order_headers"]
    asked, counted = [], quality._counted
    monkeypatch.setattr(quality, "_counted", lambda t, columns: asked.append(columns) or counted(t, columns))
    found = {r["column"]: (r["rows"], r["distinct_values"]) for r in quality.column_distinct(tables, names).collect()}
    assert found["salesorder"] == (9003, 9001) and found["salesorderitem"] == (9003, 8)
    assert asked == [[("sales_order_items", "salesorder")]]
    assert [r["column"] for r in quality.key_candidates(tables, names).collect()] == ["salesorder"]
