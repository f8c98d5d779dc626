"""Order-to-cash collections derived from order and line-item tables.

Line items give the sales, delivery and billing items of one order; delivery,
billing, accounting and payment documents get number ranges of their own. Line
numbers repeat within an order, so the lines are numbered anew first; that table
is staged, and all item collections are projections of it without a shuffle.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.keys import ITEM_WIDTH, item6
from ledgerloom.session import stage
from ledgerloom.sources.catalog import Collections

# First number of each document range.
DELIVERY_BASE = 80_000_000
BILLING_BASE = 90_000_000
ACCOUNTING_BASE = 9_400_000_000
PAYMENT_BASE = 9_500_000_000
CURRENCY = "USD"
MONEY = "decimal(15,2)"


def _text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def _number(base: int, key: str = "ok") -> Column:
    return _text(F.lit(base) + F.col(key))


def _iso(date: Column | str) -> Column:
    return F.concat(_text(date), F.lit("T00:00:00.000Z"))


def _item() -> Column:
    return _text(F.col("ln") * 10)


# All columns of a line but its order, by which the lines of an order are numbered.
LINE_ORDER = (
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)


def numbered_lines(lineitem: DataFrame) -> DataFrame:
    """Every line, numbered from 1 within its order.

    Line numbers repeat within an order, so all columns decide the number; lines
    that agree in all of them are interchangeable. A window holds one order.
    """
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    return lineitem.select(
        F.col("l_orderkey").alias("ok"),
        number.alias("ln"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_quantity").cast(MONEY).alias("qty"),
        F.col("l_extendedprice").cast(MONEY).alias("amt"),
        F.col("l_shipdate").cast("date").alias("shipdate"),
        F.col("l_linestatus").alias("ls"),
        F.col("l_returnflag").alias("rf"),
    )


def billed_orders(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per order with billed lines: the order is invoiced as one document."""
    billed = (
        lines.filter(F.col("rf").isin("N", "R"))
        .groupBy("ok")
        .agg(
            F.min("shipdate").alias("billed_on"),
            F.sum("amt").alias("total"),
            F.bool_and(F.col("rf") == "R").alias("cancelled"),
        )
    )
    header = orders.select(
        F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status")
    )
    return billed.join(header, "ok")


def delivered_orders(lines: DataFrame) -> DataFrame:
    """One row per order with delivered lines: the order is shipped as one delivery."""
    return (
        lines.filter(F.col("ls") == "O")
        .groupBy("ok")
        .agg(
            F.min("suppkey").alias("shipping_point"),
            F.min("shipdate").alias("shipped_on"),
            F.bool_and(F.col("rf") == "A").alias("pending"),
        )
    )


def order_to_cash(spark: SparkSession, folder: str, owner: str = "queries") -> Collections:
    """The collections derived from the parquet tables in ``folder``; ``owner`` owns what is staged."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(posixpath.join(folder, f"{name}.parquet"))

    @cache
    def lines() -> DataFrame:
        return stage(numbered_lines(table("lineitem")), "lines", owner=owner)

    @cache
    def billed() -> DataFrame:
        return stage(billed_orders(lines(), table("orders")), "billed-orders", owner=owner)

    @cache
    def delivered() -> DataFrame:
        return stage(delivered_orders(lines()), "delivered-orders", owner=owner)

    def billed_lines() -> DataFrame:
        return lines().filter(F.col("rf").isin("N", "R"))

    @cache
    def numbered() -> bool:
        """Whether six characters tell the items of every order apart; its lines are numbered, so nothing else can repeat."""
        most = lines().agg(F.max(F.col("ln").cast("long") * 10).alias("item")).first()["item"]
        return (most or 0) < 10**ITEM_WIDTH

    def posted() -> DataFrame:
        return billed().filter(F.col("status") != "O")

    builders: dict[str, Callable[[], DataFrame]] = {
        "sales_order_headers": lambda: table("orders").select(
            _text("o_orderkey").alias("salesorder"),
            F.lit("OR").alias("salesordertype"),
            _text("o_custkey").alias("soldtoparty"),
            _iso(F.col("o_orderdate").cast("date")).alias("creationdate"),
            _text(F.col("o_totalprice").cast(MONEY)).alias("totalnetamount"),
            F.lit(CURRENCY).alias("transactioncurrency"),
            F.col("o_orderstatus").alias("overalldeliverystatus"),
            F.col("o_orderstatus").alias("overallordreltdbillgstatus"),
        ),
        "sales_order_items": lambda: lines().select(
            _text("ok").alias("salesorder"),
            _item().alias("salesorderitem"),
            _text("partkey").alias("material"),
            _text("qty").alias("requestedquantity"),
            F.lit("PC").alias("requestedquantityunit"),
            _text("amt").alias("netamount"),
            F.lit(CURRENCY).alias("transactioncurrency"),
            _text("suppkey").alias("productionplant"),
        ),
        "sales_order_schedule_lines": lambda: lines().select(
            _text("ok").alias("salesorder"),
            _item().alias("salesorderitem"),
            F.lit("1").alias("scheduleline"),
            _iso("shipdate").alias("confirmeddeliverydate"),
            _text("qty").alias("confdorderqtybymatlavailcheck"),
        ),
        "outbound_delivery_headers": lambda: delivered().select(
            _number(DELIVERY_BASE).alias("deliverydocument"),
            _iso("shipped_on").alias("creationdate"),
            F.when(~F.col("pending"), _iso("shipped_on")).alias("actualgoodsmovementdate"),
            F.when(F.col("pending"), "A").otherwise("C").alias("overallgoodsmovementstatus"),
            _text("shipping_point").alias("shippingpoint"),
        ),
        "outbound_delivery_items": lambda: lines()
        .filter(F.col("ls") == "O")
        .select(
            _number(DELIVERY_BASE).alias("deliverydocument"),
            item6(_item()).alias("deliverydocumentitem"),
            _text("qty").alias("actualdeliveryquantity"),
            _text("ok").alias("referencesddocument"),
            item6(_item()).alias("referencesddocumentitem"),
            _text("suppkey").alias("plant"),
        ),
        "billing_document_headers": lambda: billed().select(
            _number(BILLING_BASE).alias("billingdocument"),
            F.lit("F2").alias("billingdocumenttype"),
            _iso("billed_on").alias("creationdate"),
            F.to_json(
                F.struct(
                    (F.col("ok") % 24).alias("hours"),
                    (F.col("ok") % 60).alias("minutes"),
                    (F.col("custkey") % 60).alias("seconds"),
                )
            ).alias("creationtime"),
            _iso("billed_on").alias("billingdocumentdate"),
            F.col("cancelled").alias("billingdocumentiscancelled"),
            _text("total").alias("totalnetamount"),
            F.lit(CURRENCY).alias("transactioncurrency"),
            _number(ACCOUNTING_BASE).alias("accountingdocument"),
            _text("custkey").alias("soldtoparty"),
        ),
        "billing_document_items": lambda: billed_lines().select(
            _number(BILLING_BASE).alias("billingdocument"),
            _item().alias("billingdocumentitem"),
            _text("partkey").alias("material"),
            _text("qty").alias("billingquantity"),
            _text("amt").alias("netamount"),
            F.lit(CURRENCY).alias("transactioncurrency"),
            _number(DELIVERY_BASE).alias("referencesddocument"),
            _item().alias("referencesddocumentitem"),
        ),
        "billing_document_cancellations": lambda: billed()
        .filter("cancelled")
        .select(
            _number(BILLING_BASE).alias("billingdocument"),
            _number(BILLING_BASE).alias("cancelledbillingdocument"),
            F.lit(True).alias("billingdocumentiscancelled"),
        ),
        "journal_entry_items_accounts_receivable": lambda: posted().select(
            _number(ACCOUNTING_BASE).alias("accountingdocument"),
            F.lit("1").alias("accountingdocumentitem"),
            _number(BILLING_BASE).alias("referencedocument"),
            _text("custkey").alias("customer"),
            _iso("billed_on").alias("postingdate"),
            _text("total").alias("amountintransactioncurrency"),
            F.lit(CURRENCY).alias("transactioncurrency"),
        ),
        "payments_accounts_receivable": lambda: posted()
        .filter(F.col("status") == "F")
        .select(
            "*",
            F.explode(
                F.when(F.col("ok") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
            ).alias("k"),
        )
        .select(
            _text(F.lit(PAYMENT_BASE) + F.col("ok") * 10 + F.col("k")).alias("accountingdocument"),
            F.lit("1").alias("accountingdocumentitem"),
            _text("custkey").alias("customer"),
            _iso(F.date_add("billed_on", (F.col("ok") % 45 + 1).cast("int"))).alias("clearingdate"),
            _text("total").alias("amountintransactioncurrency"),
            F.lit(CURRENCY).alias("transactioncurrency"),
            _number(ACCOUNTING_BASE).alias("clearingaccountingdocument"),
        ),
        "business_partners": lambda: table("customer").select(
            _text("c_custkey").alias("businesspartner"),
            F.col("c_name").alias("businesspartnerfullname"),
            F.col("c_name").alias("businesspartnername"),
            F.col("c_mktsegment").alias("businesspartnercategory"),
        ),
        "business_partner_addresses": lambda: table("customer")
        .join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _text("n_nationkey").alias("addressid"),
            _text("c_custkey").alias("businesspartner"),
            F.col("n_name").alias("cityname"),
            F.col("r_name").alias("country"),
        ),
        "products": lambda: table("part").select(
            _text("p_partkey").alias("product"),
            F.col("p_type").alias("producttype"),
            F.col("p_brand").alias("productgroup"),
            F.lit("PC").alias("baseunit"),
        ),
        "product_descriptions": lambda: table("part").select(
            _text("p_partkey").alias("product"),
            F.lit("EN").alias("language"),
            F.col("p_name").alias("productdescription"),
        ),
        "plants": lambda: table("supplier").select(
            _text("s_suppkey").alias("plant"),
            F.col("s_name").alias("plantname"),
            _text("s_nationkey").alias("addressid"),
        ),
        "product_plants": lambda: lines()
        .select(_text("partkey").alias("product"), _text("suppkey").alias("plant"))
        .distinct(),
        "product_storage_locations": lambda: lines()
        .select(
            _text("partkey").alias("product"),
            _text("suppkey").alias("plant"),
            F.concat(F.lit("SL"), F.col("ls"), F.col("rf")).alias("storagelocation"),
        )
        .distinct(),
        "customer_company_assignments": lambda: table("customer").select(
            _text("c_custkey").alias("customer"), F.lit("1000").alias("companycode")
        ),
        "customer_sales_area_assignments": lambda: table("customer").select(
            _text("c_custkey").alias("customer"),
            _text("c_nationkey").alias("salesorganization"),
            F.lit("10").alias("distributionchannel"),
            F.lit("00").alias("division"),
            F.lit(CURRENCY).alias("currency"),
        ),
    }
    keyed = {
        "sales_order_items": numbered,
        "outbound_delivery_headers": lambda: True,  # one row per order of the lines
        "outbound_delivery_items": numbered,
        "billing_document_items": numbered,
    }
    return Collections(spark, builders, keyed)
