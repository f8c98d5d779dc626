"""Registered queries: name to a function of (workspace)."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.metadata import parse_metadata
from ledgerloom.functions.typed import amount, day, iso_timestamp, timestamp
from ledgerloom.operators import analytics, flows, graph_build, graph_checks, graph_query, prompts, quality
from ledgerloom.operators.trace import DOCUMENT, Trace, trace_facts
from ledgerloom.plans.workspace import FILES, Workspace, open_workspace
from ledgerloom.session import staging_path
from ledgerloom.sources import graph_store, ingest, jsonl
from ledgerloom.sources.catalog import COLLECTIONS, CORE_COLLECTIONS, ITEM_KEY_COLUMN, ITEM_KEYS
from ledgerloom.sources.merge_store import MergeStore

AS_OF = datetime.date(1998, 8, 2)
CUSTOMER_TO_PRODUCT = ("CUSTOMER_PLACED_ORDER", "ORDER_HAS_ITEM", "ITEM_FOR_PRODUCT")
# Node types whose subgraphs are asked for at depth 2, and whose neighbourhoods are merged.
DEEP_SEEDS = ("Plant", "Address", "Payment")
MERGED_SEEDS = ("Delivery", "BillingDocument")
PAYMENT_TO_CUSTOMER = (
    "PAYMENT_CLEARS_JOURNAL_ENTRY",
    "BILLING_DOCUMENT_POSTED_TO_JOURNAL_ENTRY",
    "BILLING_DOCUMENT_FOR_CUSTOMER",
)

Query = Callable[[Workspace], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _register(name: str, function: Query) -> None:
    REGISTRY[name] = function


# --- Loading ---------------------------------------------------------------


@query
def table_counts(w: Workspace) -> DataFrame:
    return ingest.row_counts(w.tables).unionByName(graph_store.counts(w.graph))


@query
def required_collections(w: Workspace) -> DataFrame:
    return ingest.collection_check(w.tables)


@query
def load_summary(w: Workspace) -> DataFrame:
    report = ingest.load_report(w.spark, w.jsonl_root, CORE_COLLECTIONS, FILES)
    return ingest.with_total(report).select("collection", "inserted", "errors", "files", "status")


@query
def ingest_report(w: Workspace) -> DataFrame:
    return ingest.with_total(w.ingested[1]).select("collection", "inserted", "errors", "files", "status")


@query
def rejected_lines(w: Workspace) -> DataFrame:
    """Lines that the ingest has set aside, and why."""
    return ingest.open_rejected(w.spark, w.ingested[0]).select("collection", "line", "reason")


@query
def ingested_items(w: Workspace) -> DataFrame:
    """Items of all orders as read back from the ingested tables."""
    tables = ingest.open_tables(w.spark, w.ingested[0])
    return tables["sales_order_items"].select(*w.tables["sales_order_items"].columns)


@query
def ingested_counts(w: Workspace) -> DataFrame:
    return ingest.row_counts(ingest.open_tables(w.spark, w.ingested[0]))


@query
def resolved_paths(w: Workspace) -> DataFrame:
    """Lines of the item collections when asked for by folder and by the name of a file there isn't."""
    parts = []
    for name in ITEM_KEYS:
        folder = w.jsonl(name)
        for asked, path in (("folder", folder), ("file", folder + jsonl.SUFFIX)):
            counted = jsonl.Source(w.spark, path, name, FILES).lines().agg(F.count("*").alias("lines"))
            parts.append(counted.select(F.lit(name).alias("collection"), F.lit(asked).alias("asked"), "lines"))
    return reduce(DataFrame.unionByName, parts)


def _loaded(name: str) -> Query:
    def run(w: Workspace) -> DataFrame:
        return jsonl.read_collection(w.spark, w.jsonl(name), name, FILES).select(*w.tables[name].columns)

    return run


for _name in ("sales_order_items", "outbound_delivery_items", "billing_document_items"):
    _register(f"load_{_name}", _loaded(_name))


@query
def normalized_item_keys(w: Workspace) -> DataFrame:
    parts = []
    for name in ITEM_KEYS:
        loaded = jsonl.read_collection(w.spark, w.jsonl(name), name, FILES)
        parts.append(loaded.select(F.lit(name).alias("collection"), F.col(ITEM_KEY_COLUMN).alias("item_key")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def schema_listing(w: Workspace) -> DataFrame:
    names = list(COLLECTIONS)
    listed = ingest.list_schema(w.tables, names)
    filled = quality.column_profile(w.tables, names).select("collection", "column", "rows", "non_null")
    return listed.join(filled, ["collection", "column"]).select(
        "collection",
        "column",
        "data_type",
        "is_key",
        "rows",
        (F.col("non_null") < F.col("rows")).alias("has_nulls"),
    )


@query
def typed_billing_headers(w: Workspace) -> DataFrame:
    return w.tables["billing_document_headers"].select(
        "billingdocument",
        amount(F.col("totalnetamount")).alias("total_net_amount"),
        day(F.col("billingdocumentdate")).cast("string").alias("billed_on"),
        iso_timestamp(F.col("creationdate"), F.col("creationtime")).alias("created_iso"),
        timestamp(F.col("creationdate"), F.col("creationtime")).alias("created_at"),
    )


@query
def node_metadata_members(w: Workspace) -> DataFrame:
    members = w.graph.nodes.select("node_type", F.explode(parse_metadata(F.col("metadata_json"))).alias("member", "value"))
    return members.groupBy("node_type", "member").agg(
        F.count("*").alias("nodes"), F.count("value").alias("filled")
    )


# --- Graph projection --------------------------------------------------------


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name).lstrip("_")


for _type in graph_build.NODE_KINDS:
    _register(f"nodes_{_snake(_type)}", lambda w, t=_type: graph_build.nodes_of_type(w.tables, t))
for _type in graph_build.EDGE_BUILDERS:
    _register(f"edges_{_type.lower()}", lambda w, t=_type: graph_build.edges_of_type(w.tables, t))
_register("edges_billed_for", lambda w: graph_build.billed_for(w.tables))
_register("graph_nodes", lambda w: graph_build.build_nodes(w.tables))
_register("graph_edges", lambda w: graph_build.build_edges(w.tables))


@query
def node_id_report(w: Workspace) -> DataFrame:
    return graph_checks.id_report(w.graph.nodes, "node_id", "node_type")


@query
def edge_id_report(w: Workspace) -> DataFrame:
    return graph_checks.id_report(w.graph.edges, "edge_id", "edge_type")


def _all_edges(w: Workspace) -> DataFrame:
    extra = graph_build.billed_for(w.tables).withColumn("edge_type", F.lit(graph_build.BILLED_FOR))
    return w.graph.edges.unionByName(extra)


def _all_absent(w: Workspace) -> DataFrame:
    """Ids that the graph or the extra edges lead to, but no node has."""
    nodes, edges = graph_build.repeating(w.tables)
    return graph_checks.absent_ends(nodes, edges.unionByName(graph_build.billed_for(w.tables)))


@query
def dangling_counts(w: Workspace) -> DataFrame:
    return graph_checks.dangling_counts(w.graph.nodes, _all_edges(w), _all_absent(w))


@query
def dangling_edges(w: Workspace) -> DataFrame:
    return graph_checks.dangling_edges(w.graph.nodes, _all_edges(w), _all_absent(w))


@query
def graph_sink(w: Workspace) -> DataFrame:
    """Rows per type of the graph as written with its ids checked, and read back."""
    written = w.write_graph("sink")
    nodes = graph_query.type_counts(written.nodes, "node_type").withColumnRenamed("node_type", "type")
    return nodes.unionByName(graph_query.type_counts(written.edges, "edge_type").withColumnRenamed("edge_type", "type"))


@query
def exported_products(w: Workspace) -> DataFrame:
    """The ranking of products as read back from an export in either format."""
    ranking, parts = flows.products_by_billing(w.tables), []
    for kind in ("csv", "json"):
        path = staging_path(w.spark, f"export-{kind}", w.owner)
        ingest.export(ranking, path, kind)
        reader = w.spark.read.schema(ranking.schema)
        read = reader.option("header", "true").csv(path) if kind == "csv" else reader.json(path)
        parts.append(read.select(F.lit(kind).alias("format"), *ranking.columns))
    return parts[0].unionByName(parts[1])


@query
def graph_totals(w: Workspace) -> DataFrame:
    return graph_store.counts(w.graph)


# --- Graph queries -----------------------------------------------------------


def _ids_of_type(w: Workspace, node_type: str, column: str) -> DataFrame:
    return w.graph.nodes.filter(F.col("node_type") == node_type).select(F.col("node_id").alias(column))


def _cancelled_document_ids(w: Workspace) -> DataFrame:
    cancelled = w.tables["billing_document_cancellations"]
    return cancelled.select(F.concat(F.lit("billingdocument_"), F.col("billingdocument")).alias("node_id"))


@query
def node_lookup(w: Workspace) -> DataFrame:
    return graph_query.stored_lookup(w.stored, _cancelled_document_ids(w))


@query
def node_edges(w: Workspace) -> DataFrame:
    return graph_query.incident_edges(*w.graph, absent=w.absent)


@query
def node_neighbors(w: Workspace) -> DataFrame:
    return graph_query.stored_neighbors(w.stored, _cancelled_document_ids(w))


@query
def node_related_counts(w: Workspace) -> DataFrame:
    return graph_query.related_counts(w.graph.nodes, w.pairs, absent=w.absent, single=True)


@query
def node_details(w: Workspace) -> DataFrame:
    """Each order with its related nodes, a row each, and its lead times."""
    times = analytics.lead_times(w.tables).withColumn("node_id", F.concat(F.lit("salesorder_"), F.col("salesorder")))
    orders = _ids_of_type(w, "SalesOrder", "node_id")
    return graph_query.neighbors(*w.graph, orders, types=["SalesOrder"], about=times.drop("salesorder"))


@query
def node_details_lead_times(w: Workspace) -> DataFrame:
    orders = _ids_of_type(w, "SalesOrder", "node_id")
    absent = graph_checks.absent_ends(*graph_query.around(*graph_build.repeating(w.tables), ["SalesOrder"]))
    related = graph_query.related_counts(*w.graph, orders, absent, ["SalesOrder"])
    times = analytics.lead_times(w.tables).withColumn(
        "node_id", F.concat(F.lit("salesorder_"), F.col("salesorder"))
    )
    return times.drop("salesorder").join(related, "node_id").select(
        "node_id", "related_type", "related", "days_to_invoice", "days_to_payment", "total_o2c_days"
    )


@query
def subgraph_nodes_depth_1(w: Workspace) -> DataFrame:
    found = graph_query.subgraph_nodes(w.graph.nodes, w.pairs, None, depth=1, absent=w.absent, single=True)
    return found.select("seed_id", "node_id", "node_type", "label")


@query
def subgraph_edges_depth_1(w: Workspace) -> DataFrame:
    return graph_query.subgraph_edges(*w.graph, None, depth=1, absent=w.absent).select("seed_id", "edge_id", "edge_type")


def _deep_seeds(w: Workspace) -> DataFrame:
    kinds = [_ids_of_type(w, t, "seed_id") for t in DEEP_SEEDS]
    return reduce(DataFrame.unionByName, kinds)


@query
def subgraph_nodes_depth_2(w: Workspace) -> DataFrame:
    edges = w.links(DEEP_SEEDS, 2)
    return graph_query.subgraph_nodes(w.graph.nodes, edges, _deep_seeds(w), depth=2, types=DEEP_SEEDS)


@query
def subgraph_edges_depth_2(w: Workspace) -> DataFrame:
    return graph_query.subgraph_edges(*w.graph, _deep_seeds(w), depth=2, types=DEEP_SEEDS)


@query
def subgraph_nodes_depth_3(w: Workspace) -> DataFrame:
    """What three hops reach from each payment: entry, invoice, and the invoice's items and customer."""
    seeds = _ids_of_type(w, "Payment", "seed_id")
    found = graph_query.subgraph_nodes(w.graph.nodes, w.links(["Payment"], 3), seeds, depth=3, types=["Payment"])
    return found.select("seed_id", "node_id", "node_type", "label")


@query
def node_counts(w: Workspace) -> DataFrame:
    return graph_query.type_counts(w.graph.nodes, "node_type")


@query
def edge_counts(w: Workspace) -> DataFrame:
    return graph_query.type_counts(w.graph.edges, "edge_type")


@query
def graph_overview(w: Workspace) -> DataFrame:
    return graph_query.overview(*w.graph)


@query
def sample_nodes(w: Workspace) -> DataFrame:
    return graph_query.sample_nodes(w.graph.nodes)


@query
def sample_edges(w: Workspace) -> DataFrame:
    return graph_query.sample_edges(w.graph.edges)


@query
def merged_subgraph_nodes(w: Workspace) -> DataFrame:
    """The neighbourhoods of all deliveries, then those of all invoices, as one set of nodes."""
    found = []
    for kind in MERGED_SEEDS:
        near = graph_query.subgraph_nodes(*w.graph, _ids_of_type(w, kind, "seed_id"), depth=1, types=[kind])
        found.append(near.drop("seed_id", "metadata_json"))
    return graph_query.merge(found, "node_id").select("node_id", "node_type", "label", "batch")


@query
def appended_subgraph_nodes(w: Workspace) -> DataFrame:
    """The same merge, batch after batch in a store: the second rewrites nothing of the first."""
    store = MergeStore(w.spark, staging_path(w.spark, "merged", w.owner), "node_id")
    for kind in MERGED_SEEDS:
        found = graph_query.subgraph_nodes(*w.graph, _ids_of_type(w, kind, "seed_id"), depth=1, types=[kind])
        store.append(found.select("node_id", "node_type", "label"))
    return store.read().select("node_id", "node_type", "label", F.col("batch").cast("int").alias("batch"))


@query
def merged_subgraph_edges(w: Workspace) -> DataFrame:
    found = []
    for kind in MERGED_SEEDS:
        near = graph_query.subgraph_edges(*w.graph, _ids_of_type(w, kind, "seed_id"), depth=1, types=[kind])
        found.append(near.drop("seed_id", "metadata_json"))
    return graph_query.merge(found, "edge_id").select("edge_id", "source_id", "target_id", "edge_type", "batch")


@query
def highlighted_nodes(w: Workspace) -> DataFrame:
    broken = flows.delivered_not_billed(w.tables)
    referenced = broken.select(F.concat(F.lit("delivery_"), F.col("deliverydocument")).alias("ref_id"))
    return graph_query.highlight(w.graph.nodes.select("node_id", "node_type"), "node_id", referenced)


@query
def highlighted_edges(w: Workspace) -> DataFrame:
    trace = Trace(w.tables).edges().select(F.col("edge_id").alias("ref_id"))
    return graph_query.highlight(w.graph.edges.select("edge_id", "edge_type"), "edge_id", trace)


@query
def node_page(w: Workspace) -> DataFrame:
    return graph_query.stored_node_page(w.stored, "SalesOrder", limit=100, after_id="salesorder_12")


@query
def edge_page(w: Workspace) -> DataFrame:
    return graph_query.stored_edge_page(
        w.stored, limit=500, after_id="delivery_item_from_plant_8", source_type="DeliveryItem"
    )


@query
def filtered_edges(w: Workspace) -> DataFrame:
    return graph_query.filter_edges(w.graph.edges, source_type="BillingDocument").select(
        "edge_id", "source_id", "target_id", "edge_type"
    )


@query
def path_customer_to_product(w: Workspace) -> DataFrame:
    return graph_query.typed_path(*w.graph, CUSTOMER_TO_PRODUCT)


@query
def path_payment_to_customer(w: Workspace) -> DataFrame:
    return graph_query.typed_path(*w.graph, PAYMENT_TO_CUSTOMER)


@query
def path_counts_customer_to_product(w: Workspace) -> DataFrame:
    return graph_query.path_counts(*w.graph, CUSTOMER_TO_PRODUCT).withColumn("paths", F.col("paths").cast("bigint"))


@query
def stored_node_edges(w: Workspace) -> DataFrame:
    """Edges of the plants of a few suppliers, by the ranges and Bloom filters of the stored graph."""
    plants = w.tables["plants"].orderBy("plant").limit(5)
    return graph_query.stored_incident_edges(w.stored, plants.select(F.concat(F.lit("plant_"), "plant").alias("node_id")))


# --- Flows and traces --------------------------------------------------------


@query
def top_products(w: Workspace) -> DataFrame:
    return flows.top_products(w.tables)


@query
def products_by_billing(w: Workspace) -> DataFrame:
    return flows.products_by_billing(w.tables)


@query
def delivered_not_billed(w: Workspace) -> DataFrame:
    return flows.delivered_not_billed(w.tables)


@query
def billed_without_delivery(w: Workspace) -> DataFrame:
    return flows.billed_without_delivery(w.tables)


@query
def orders_without_downstream(w: Workspace) -> DataFrame:
    return flows.orders_without_downstream(w.tables)


@query
def broken_flow_summary(w: Workspace) -> DataFrame:
    summary = flows.broken_flow_summary(w.tables)
    return summary.select("bucket", "count", F.array_join("sample_ids", ",").alias("sample_ids"))


@query
def trace_nodes(w: Workspace) -> DataFrame:
    return Trace(w.tables).nodes()


@query
def trace_edges(w: Workspace) -> DataFrame:
    return Trace(w.tables).edges()


@query
def trace_summary(w: Workspace) -> DataFrame:
    return Trace(w.tables).summary()


@query
def trace_answer_facts(w: Workspace) -> DataFrame:
    return trace_facts(w.tables)


# --- Quality -----------------------------------------------------------------


@query
def join_coverage(w: Workspace) -> DataFrame:
    return quality.join_coverage(w.tables)


@query
def schema_joins(w: Workspace) -> DataFrame:
    return quality.list_joins(w.tables)


@query
def collection_profile(w: Workspace) -> DataFrame:
    return quality.collection_profile(w.tables, COLLECTIONS)


@query
def sample_records(w: Workspace) -> DataFrame:
    return quality.sample_records(w.tables, COLLECTIONS)


@query
def column_distinct(w: Workspace) -> DataFrame:
    return quality.column_distinct(w.tables, COLLECTIONS)


@query
def key_candidates(w: Workspace) -> DataFrame:
    return quality.key_candidates(w.tables, COLLECTIONS)


@query
def shared_columns(w: Workspace) -> DataFrame:
    return quality.shared_columns(w.tables, COLLECTIONS)


@query
def inventory(w: Workspace) -> DataFrame:
    return quality.inventory(w.tables, COLLECTIONS)


# --- Analytics ---------------------------------------------------------------


@query
def billing_by_product(w: Workspace) -> DataFrame:
    return analytics.billing_by_product(w.tables)


@query
def invoice_lines(w: Workspace) -> DataFrame:
    return analytics.invoice_lines(w.tables)


@query
def orders_without_delivery(w: Workspace) -> DataFrame:
    return analytics.orders_without_delivery(w.tables)


@query
def deliveries_without_invoice(w: Workspace) -> DataFrame:
    return analytics.deliveries_without_invoice(w.tables)


@query
def invoices_without_payment(w: Workspace) -> DataFrame:
    return analytics.invoices_without_payment(w.tables)


@query
def incomplete_flow_counts(w: Workspace) -> DataFrame:
    return analytics.incomplete_flow_counts(w.tables)


@query
def cycle_time_histogram(w: Workspace) -> DataFrame:
    return analytics.cycle_time_histogram(w.tables)


@query
def cycle_time_summary(w: Workspace) -> DataFrame:
    return analytics.cycle_time_summary(w.tables)


@query
def customer_payments(w: Workspace) -> DataFrame:
    return analytics.customer_payments(w.tables)


@query
def duplicate_payments(w: Workspace) -> DataFrame:
    return analytics.duplicate_payments(w.tables)


@query
def recent_duplicate_payments(w: Workspace) -> DataFrame:
    return analytics.recent_duplicate_payments(w.tables, AS_OF)


@query
def cancelled_impact(w: Workspace) -> DataFrame:
    return analytics.cancelled_impact(w.tables)


@query
def plant_performance(w: Workspace) -> DataFrame:
    return analytics.plant_performance(w.tables)


@query
def active_invoices(w: Workspace) -> DataFrame:
    return analytics.active_invoices(w.tables)


@query
def slowest_orders(w: Workspace) -> DataFrame:
    return analytics.slowest_orders(w.tables, AS_OF)


@query
def overdue_orders(w: Workspace) -> DataFrame:
    overdue = analytics.overdue_orders(w.tables, AS_OF, complete_status="F")
    return overdue.select("salesorder", F.col("created_on").cast("string").alias("created_on"), "age_days")


@query
def lead_times(w: Workspace) -> DataFrame:
    return analytics.lead_times(w.tables)


@query
def product_plant_density(w: Workspace) -> DataFrame:
    return analytics.product_plant_density(w.tables)


@query
def storage_by_plant(w: Workspace) -> DataFrame:
    return analytics.storage_by_plant(w.tables)


# --- Prompts -----------------------------------------------------------------


@query
def prompt_guard(w: Workspace) -> DataFrame:
    return prompts.guard(w.prompts()).select("prompt_id", "in_domain", "reason")


@query
def prompt_intent(w: Workspace) -> DataFrame:
    return prompts.route(w.prompts()).drop("prompt")


@query
def prompt_answers(w: Workspace) -> DataFrame:
    return prompts.answer(w.prompts(), w.tables).select(
        "prompt_id",
        "intent",
        "answer_text",
        "requires_clarification",
        DOCUMENT,
        F.array_join("cited_ids", ",").alias("cited_ids"),
        F.array_join("cited_node_ids", ",").alias("cited_node_ids"),
        "cited_data_summary",
    )


@query
def prompt_trace_references(w: Workspace) -> DataFrame:
    return prompts.trace_references(w.prompts(), w.tables)


def bound(name: str) -> Callable[[SparkSession, str], DataFrame]:
    run = REGISTRY[name]
    return lambda spark, folder: run(open_workspace(spark, folder))
