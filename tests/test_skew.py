"""One key with a third of all rows: results stay whole and joins split the key."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import analytics, flows, graph_build, quality
from ledgerloom.operators.trace import Trace
from ledgerloom.sources.catalog import Collections

ROWS = 120_000
HOT = ROWS // 3
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def split_early(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture
def hot(split_early):
    """A third of the billing items refer to one delivery item and are in one billing document."""
    spark = split_early
    number = spark.range(0, ROWS, 1, 8).select("id", (F.col("id") < HOT).alias("is_hot"))

    def text(column):
        return F.col(column).cast("string")

    billing = number.select(
        F.when(F.col("is_hot"), "b0").otherwise(F.concat(F.lit("b"), text("id"))).alias("billingdocument"),
        text("id").alias("billingdocumentitem"),
        F.when(F.col("is_hot"), "m0").otherwise(F.concat(F.lit("m"), (F.col("id") % 10).cast("string"))).alias("material"),
        F.lit("1").alias("billingquantity"),
        F.lit("1.00").alias("netamount"),
        F.when(F.col("is_hot"), "d0").otherwise(F.concat(F.lit("d"), text("id"))).alias("referencesddocument"),
        F.lit("10").alias("referencesddocumentitem"),
    )
    kept = number.filter((F.col("id") == 0) | ~F.col("is_hot"))
    copies = number.filter("is_hot").select(
        F.lit("d0").alias("deliverydocument"), F.lit("000010").alias("deliverydocumentitem"),
        F.lit("s0").alias("referencesddocument"), F.lit("000010").alias("referencesddocumentitem"),
        F.lit("p").alias("plant"),
    )
    delivery = kept.select(
        F.concat(F.lit("d"), text("id")), F.lit("000010"), F.concat(F.lit("s"), text("id")), F.lit("000010"), F.lit("p")
    ).toDF(*copies.columns)
    headers = kept.select(
        F.concat(F.lit("b"), text("id")).alias("billingdocument"), F.concat(F.lit("a"), text("id")).alias("accountingdocument"),
        F.lit("1.00").alias("totalnetamount"),
    )
    orders = kept.select(F.concat(F.lit("s"), text("id")).alias("salesorder"))
    return Collections(
        spark,
        {
            "billing_document_items": billing,
            "outbound_delivery_items": delivery.unionByName(copies),
            "billing_document_headers": headers,
            "sales_order_headers": orders,
            "sales_order_items": orders.withColumn("salesorderitem", F.lit("10")),
        },
    )


def count_with_plan(df):
    df = df.cache()
    try:
        rows = df.count()
        return rows, df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.unpersist()


def test_edges_of_a_hot_item(hot):
    rows, plan = count_with_plan(graph_build.delivery_item_billed_by_billing_item(hot))
    assert rows == ROWS and "skew=true" in plan
    assert graph_build.item_fulfilled_by_delivery_item(hot).count() == ROWS - HOT + 1


def test_flows_of_a_hot_item(hot):
    assert flows.delivered_not_billed(hot).count() == 0
    assert flows.billed_without_delivery(hot).count() == 0
    assert flows.orders_without_downstream(hot).count() == 0
    top = flows.top_products(hot, 1).first()
    assert top["billing_document_count"] == (ROWS - HOT) // 10 + 1


def test_trace_of_a_hot_document(hot):
    trace = Trace(hot)
    summary = {r["billing_document_id"]: (r["nodes"], r["edges"]) for r in trace.summary().filter(
        "billing_document_id in ('b0', 'b50000')").collect()}
    # document, items, delivery with item, order with item; two edges per item and three more
    assert summary["b0"] == (1 + HOT + 4, 2 * HOT + 3)
    assert summary["b50000"] == (6, 5)
    assert trace.nodes().filter("billing_document_id = 'b0'").count() == HOT + 5


def test_reports_of_a_hot_document(hot):
    rows, plan = count_with_plan(analytics.invoice_lines(hot))
    assert rows == ROWS and "skew=true" in plan
    assert str(analytics.billing_by_product(hot).filter("material = 'm0'").first()["total_invoiced"]) == "48000.00"
    spec = quality.FLOW_JOINS[2]
    got = quality.join_coverage(hot, [spec]).first()
    assert (got["left_keys"], got["right_keys"], got["coverage_pct"]) == (ROWS - HOT + 1, ROWS - HOT + 1, 100.0)
