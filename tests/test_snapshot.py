"""Known results on a JSON-lines snapshot; set SNAPSHOT_DIR to its folder of collections."""

import os

import pytest
from helpers import rows_of

from ledgerloom.operators import flows, graph_build, graph_query, quality
from ledgerloom.operators.trace import DOCUMENT, Trace
from ledgerloom.sources import ingest, jsonl
from ledgerloom.sources.catalog import CORE_COLLECTIONS
from ledgerloom.sources.graph_store import Graph, write_graph

ROOT = os.environ.get("SNAPSHOT_DIR")
pytestmark = pytest.mark.skipif(not ROOT, reason="SNAPSHOT_DIR is not set")

ROWS = {
    "billing_document_headers": 63, "billing_document_items": 91, "business_partners": 8,
    "business_partner_addresses": 8, "journal_entry_items_accounts_receivable": 123,
    "outbound_delivery_items": 137, "plants": 44, "products": 69, "sales_order_items": 167,
}
NODES = {
    "Customer": 8, "Address": 8, "SalesOrderItem": 167, "Product": 69, "DeliveryItem": 137, "Plant": 44,
    "BillingDocument": 63, "BillingItem": 91, "JournalEntry": 123,
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    report = {r["collection"]: r for r in ingest.ingest(spark, ROOT, out).collect()}
    assert {n: r["inserted"] for n, r in report.items() if r["inserted"]} == ROWS
    assert all(r["errors"] == 0 for r in report.values()) and set(report) == set(CORE_COLLECTIONS)
    assert report["journal_entry_items_accounts_receivable"]["files"] == 4
    return ingest.open_tables(spark, out)


@pytest.fixture(scope="module")
def graph(tables, tmp_path_factory):
    return write_graph(
        Graph(graph_build.build_nodes(tables), graph_build.build_edges(tables)), str(tmp_path_factory.mktemp("graph"))
    )


def test_graph(graph):
    assert dict(rows_of(graph_query.type_counts(graph.nodes, "node_type"))) == NODES
    edges = dict(rows_of(graph_query.type_counts(graph.edges, "edge_type")))
    assert edges["ITEM_FULFILLED_BY_DELIVERY_ITEM"] == 137
    assert edges["DELIVERY_ITEM_BILLED_BY_BILLING_ITEM"] == 91
    assert edges["BILLING_DOCUMENT_POSTED_TO_JOURNAL_ENTRY"] == 43


def test_flows(tables):
    top = [tuple(r) for r in flows.top_products(tables, 5).collect()]
    assert top[0] == ("S8907367042006", 16) and [n for _, n in top] == [16, 6, 5, 4, 4]
    summary = {r["bucket"]: r for r in flows.broken_flow_summary(tables).collect()}
    assert summary[flows.DELIVERED_NOT_BILLED]["count"] == 50
    assert summary[flows.DELIVERED_NOT_BILLED]["sample_ids"][:3] == ["80737721", "80737722", "80737723"]
    assert summary[flows.BILLED_WITHOUT_DELIVERY]["count"] == 0


def test_trace(spark, tables):
    trace = Trace(tables, spark.createDataFrame([("91150175",)], f"{DOCUMENT} string"))
    assert rows_of(trace.summary()) == [("91150175", 3, 2)]


def test_coverage(tables):
    got = [
        (r["left_keys"], r["right_keys"], r["matched"], r["coverage_pct"], r["classification"])
        for spec in quality.FLOW_JOINS
        for r in quality.join_coverage(tables, [spec]).collect()
    ]
    assert got[1] == (167, 137, 137, 82.04, "partial")
    assert got[2] == (137, 47, 47, 34.31, "not_recommended")
    assert got[3] == (63, 123, 43, 68.25, "uncertain")
    assert got[6] == (69, 69, 69, 100.0, "confirmed_with_normalization")
    assert got[7] == (5, 44, 5, 100.0, "confirmed_with_normalization")
    assert got[8][:4] == (8, 8, 8, 100.0)
    assert got[9] == (44, 8, 0, 0.0, "not_recommended")
    assert got[0][3:] == (0.0, "not_recommended")


def test_key_candidates(spark):
    tables = ingest.open_dataset(spark, ROOT)
    found = {}
    for r in quality.key_candidates(tables, tables.available()).collect():
        found.setdefault(r["collection"], set()).add(r["column"])
    assert found == {
        "billing_document_headers": {"accountingdocument", "billingdocument"},
        "business_partner_addresses": {"addressid", "addressuuid"},
        "journal_entry_items_accounts_receivable": {"accountingdocument", "referencedocument"},
        "plants": {"addressid"},
        "products": {"productoldid"},
    }
    headers = tables["billing_document_headers"]
    assert dict(rows_of(headers.groupBy("billingdocumentiscancelled").count())) == {True: 16, False: 47}


def test_time_objects_stay_json(spark):
    df = jsonl.read_collection(spark, f"{ROOT}/business_partners", "business_partners")
    assert df.select("creationtime").first()[0].startswith('{"hours":')
