"""Business reports over the order-to-cash flow.

Chains of documents are aggregated per document before each join, so a document
with very many partners contributes one row to the next step instead of a pair
per partner. "Today" is always the parameter ``as_of``.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import item6
from ledgerloom.functions.typed import amount, day, days_between
from ledgerloom.operators.flows import open_keys
from ledgerloom.sources.catalog import Collections

MONEY_TOTAL = "decimal(38,2)"
PENDING_STATUS = "A"
COMPLETE_STATUS = "C"
OVERDUE_DAYS = 30
RECENT_DAYS = 90


def _total(column: str) -> Column:
    return F.sum(amount(F.col(column))).cast(MONEY_TOTAL)


def billing_by_product(tables: Collections, limit: int | None = None) -> DataFrame:
    """Invoices and invoiced amount per product, with the product type where known.

    Items are grouped before they meet the products.
    """
    per_material = (
        tables["billing_document_items"]
        .groupBy("material")
        .agg(F.countDistinct("billingdocument").alias("invoice_count"), _total("netamount").alias("total_invoiced"))
    )
    products = tables["products"].select("product", "producttype").distinct()
    result = per_material.join(products, F.col("material") == F.col("product"), "left").select(
        "material", "product", "producttype", "invoice_count", "total_invoiced"
    )
    if limit is None:
        return result
    return result.orderBy(F.desc("invoice_count"), F.asc_nulls_last("material")).limit(limit)


def invoice_lines(tables: Collections) -> DataFrame:
    """Every invoice line with its delivery item, sales order item and amounts.

    Lines without a delivery stay. Item numbers are compared in padded form.
    Repeated delivery rows are dropped first, so copies cannot multiply lines.
    """
    headers = tables["billing_document_headers"].select(
        "billingdocument",
        "accountingdocument",
        amount(F.col("totalnetamount")).alias("invoice_total_amount"),
        "billingdocumentdate",
    )
    lines = tables["billing_document_items"].select(
        "billingdocument",
        "billingdocumentitem",
        "material",
        amount(F.col("netamount")).alias("invoice_line_amount"),
        F.col("referencesddocument").alias("ref_document"),
        item6(F.col("referencesddocumentitem")).alias("ref_item"),
    )
    shipped = tables["outbound_delivery_items"].select(
        "deliverydocument",
        "deliverydocumentitem",
        F.col("referencesddocument").alias("salesorder"),
        F.col("referencesddocumentitem").alias("salesorderitem"),
        item6(F.col("deliverydocumentitem")).alias("item"),
    )
    shipped = shipped.distinct()
    on = (F.col("ref_document") == F.col("deliverydocument")) & (F.col("ref_item") == F.col("item"))
    return (
        lines.join(shipped, on, "left")
        .join(headers, "billingdocument")
        .select(
            "billingdocument",
            "billingdocumentitem",
            "material",
            "deliverydocument",
            "deliverydocumentitem",
            "salesorder",
            "salesorderitem",
            "accountingdocument",
            "invoice_line_amount",
            "invoice_total_amount",
            "billingdocumentdate",
        )
    )


def _without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is not in ``right``; null keys bypass the join."""
    known = left.filter(F.col(key).isNotNull()).join(right.select(key).distinct(), key, "left_anti")
    return known.unionByName(left.filter(F.col(key).isNull()).select(*known.columns))


def orders_without_delivery(tables: Collections) -> DataFrame:
    """Sales orders no delivery refers to, by document number alone."""
    delivered = tables["outbound_delivery_items"].select(
        "deliverydocument", F.col("referencesddocument").alias("salesorder")
    )
    missing = open_keys(
        tables["sales_order_headers"].select("salesorder"),
        delivered,
        ["salesorder"],
        F.col("deliverydocument").isNotNull(),
    )
    return missing.filter(F.col("salesorder").isNotNull())


def deliveries_without_invoice(tables: Collections) -> DataFrame:
    """Deliveries no billing item refers to, by document number alone."""
    billed = tables["billing_document_items"].select(
        "billingdocument", F.col("referencesddocument").alias("deliverydocument")
    )
    missing = open_keys(
        tables["outbound_delivery_items"].select("deliverydocument"),
        billed,
        ["deliverydocument"],
        F.col("billingdocument").isNotNull(),
    )
    return missing.filter(F.col("deliverydocument").isNotNull())


def invoices_without_payment(tables: Collections) -> DataFrame:
    """Invoices with a path to payment that ends without a clearing date."""
    entries = tables["journal_entry_items_accounts_receivable"].select(
        "accountingdocument", F.lit(True).alias("entry"), F.lit(None).cast("boolean").alias("cleared")
    )
    payments = tables["payments_accounts_receivable"].select(
        F.col("clearingaccountingdocument").alias("accountingdocument"),
        F.lit(False).alias("entry"),
        F.col("clearingdate").isNotNull().alias("cleared"),
    )
    settled = (
        entries.unionByName(payments)
        .dropna(subset=["accountingdocument"])
        .groupBy("accountingdocument")
        .agg(F.bool_or("entry").alias("entry"), F.bool_and("cleared").alias("cleared"))
        .filter(F.col("entry") & F.col("cleared"))
    )
    invoices = tables["billing_document_headers"].select("billingdocument", "accountingdocument").distinct()
    open_invoices = _without(invoices, settled, "accountingdocument")
    return open_invoices.filter(F.col("billingdocument").isNotNull()).select("billingdocument").distinct()


def incomplete_flow_counts(tables: Collections) -> DataFrame:
    """``(check, documents)`` of the three header-level checks."""
    checks = {
        "orders_without_delivery": orders_without_delivery(tables),
        "deliveries_without_invoice": deliveries_without_invoice(tables),
        "invoices_without_payment": invoices_without_payment(tables),
    }
    parts = [
        rows.agg(F.count("*").alias("documents")).select(F.lit(name).alias("check"), "documents")
        for name, rows in checks.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _delivery_of_order(tables: Collections) -> DataFrame:
    return (
        tables["outbound_delivery_items"]
        .select(F.col("referencesddocument").alias("salesorder"), "deliverydocument")
        .dropna()
        .distinct()
    )


def _invoice_of_delivery(tables: Collections) -> DataFrame:
    return (
        tables["billing_document_items"]
        .select(F.col("referencesddocument").alias("deliverydocument"), "billingdocument")
        .dropna()
        .distinct()
    )


def _posted_payments(tables: Collections) -> DataFrame:
    """Distinct ``(accountingdocument, paid_on)`` of payments for posted documents."""
    payments = tables["payments_accounts_receivable"].select(
        F.col("clearingaccountingdocument").alias("accountingdocument"), day(F.col("clearingdate")).alias("paid_on")
    )
    entries = tables["journal_entry_items_accounts_receivable"].select("accountingdocument")
    return payments.dropna().distinct().join(entries, "accountingdocument", "left_semi")


def order_payment_days(tables: Collections) -> DataFrame:
    """Distinct ``(salesorder, paid_on, o2c_days)`` of orders that reached a payment."""
    invoices = tables["billing_document_headers"].select("billingdocument", "accountingdocument").distinct()
    paid_invoices = invoices.join(_posted_payments(tables), "accountingdocument").select("billingdocument", "paid_on")
    paid_deliveries = (
        _invoice_of_delivery(tables)
        .join(paid_invoices.distinct(), "billingdocument")
        .select("deliverydocument", "paid_on")
        .distinct()
    )
    paid_orders = (
        _delivery_of_order(tables)
        .join(paid_deliveries, "deliverydocument")
        .select("salesorder", "paid_on")
        .distinct()
    )
    orders = (
        tables["sales_order_headers"]
        .select("salesorder", day(F.col("creationdate")).alias("created_on"))
        .join(tables["sales_order_items"].select("salesorder"), "salesorder", "left_semi")
    )
    return paid_orders.join(orders, "salesorder").select(
        "salesorder", "paid_on", days_between(F.col("created_on"), F.col("paid_on")).alias("o2c_days")
    )


def cycle_time_histogram(tables: Collections) -> DataFrame:
    """Orders per number of days from order to payment."""
    return (
        order_payment_days(tables)
        .groupBy("o2c_days")
        .agg(
            F.countDistinct("salesorder").alias("order_count"),
            F.min("o2c_days").alias("min_days"),
            F.max("o2c_days").alias("max_days"),
            F.avg("o2c_days").alias("avg_days"),
        )
    )


def cycle_time_summary(tables: Collections) -> DataFrame:
    """Orders, and least, most and average days from order to payment date."""
    return order_payment_days(tables).agg(
        F.countDistinct("salesorder").alias("order_count"),
        F.min("o2c_days").alias("min_days"),
        F.max("o2c_days").alias("max_days"),
        F.round(F.avg("o2c_days"), 4).alias("avg_days"),
    )


def customer_payments(tables: Collections) -> DataFrame:
    """Payments, amount paid and average days to pay per customer.

    A posted document counts from its first posting date, so a payment counts
    once however many items it clears. Payments are grouped by customer before
    they meet the partners.
    """
    posted = (
        tables["journal_entry_items_accounts_receivable"]
        .groupBy(F.col("accountingdocument").alias("cleared_document"))
        .agg(F.min(day(F.col("postingdate"))).alias("posted_on"))
    )
    payments = tables["payments_accounts_receivable"].select(
        "customer",
        "accountingdocument",
        "amountintransactioncurrency",
        day(F.col("clearingdate")).alias("paid_on"),
        F.col("clearingaccountingdocument").alias("cleared_document"),
    )
    per_customer = (
        payments.join(posted, "cleared_document")
        .groupBy("customer")
        .agg(
            F.countDistinct("accountingdocument").alias("payment_count"),
            _total("amountintransactioncurrency").alias("total_paid"),
            F.round(F.avg(days_between(F.col("posted_on"), F.col("paid_on"))), 4).alias("avg_days_to_pay"),
        )
    )
    partners = tables["business_partners"].select(
        F.col("businesspartner").alias("customer"), F.col("businesspartnerfullname").alias("customer_name")
    )
    return per_customer.join(partners.distinct(), "customer").select(
        "customer", "customer_name", "payment_count", "total_paid", "avg_days_to_pay"
    )


def duplicate_payments(tables: Collections) -> DataFrame:
    """Cleared documents with more than one payment."""
    return (
        tables["payments_accounts_receivable"]
        .groupBy("clearingaccountingdocument")
        .agg(F.count("*").alias("payment_count"), _total("amountintransactioncurrency").alias("total_paid"))
        .filter(F.col("payment_count") > 1)
    )


def recent_duplicate_payments(tables: Collections, as_of: datetime.date, days: int = RECENT_DAYS) -> DataFrame:
    """Invoices dated within ``days`` before ``as_of`` that were paid more than once.

    The invoice date limits the documents before payments are looked up.
    """
    since = as_of - datetime.timedelta(days=days)
    invoices = (
        tables["billing_document_headers"]
        .filter(day(F.col("billingdocumentdate")) >= F.lit(since))
        .select("billingdocument", "accountingdocument")
        .distinct()
    )
    repeated = duplicate_payments(tables).withColumnRenamed("clearingaccountingdocument", "accountingdocument")
    return invoices.join(repeated, "accountingdocument").select("billingdocument", "payment_count", "total_paid")


def cancelled_impact(tables: Collections) -> DataFrame:
    """Number and value of cancelled invoices, valued by their own headers."""
    cancelled = tables["billing_document_cancellations"].select("billingdocument")
    headers = tables["billing_document_headers"].select("billingdocument", "totalnetamount")
    return headers.join(cancelled, "billingdocument", "left_semi").agg(
        F.countDistinct("billingdocument").alias("cancelled_count"), _total("totalnetamount").alias("cancelled_value")
    )


def plant_performance(tables: Collections, pending_status: str = PENDING_STATUS) -> DataFrame:
    """Deliveries, delivered quantity and items of pending deliveries per plant."""
    pending = (
        tables["outbound_delivery_headers"]
        .filter(F.col("overallgoodsmovementstatus") == pending_status)
        .select("deliverydocument", F.lit(True).alias("pending"))
        .distinct()
    )
    per_plant = (
        tables["outbound_delivery_items"]
        .filter(F.col("plant").isNotNull())
        .select("plant", "deliverydocument", "actualdeliveryquantity")
        .join(pending, "deliverydocument", "left")
        .groupBy("plant")
        .agg(
            F.countDistinct("deliverydocument").alias("delivery_count"),
            _total("actualdeliveryquantity").alias("total_qty_delivered"),
            F.count("pending").alias("pending_deliveries"),
        )
    )
    plants = tables["plants"].select("plant", "plantname").distinct()
    return per_plant.join(plants, "plant").select(
        "plant", "plantname", "delivery_count", "total_qty_delivered", "pending_deliveries"
    )


def active_invoices(tables: Collections) -> DataFrame:
    """Invoices neither flagged as cancelled nor listed as cancelled."""
    headers = tables["billing_document_headers"].filter(
        ~F.coalesce("billingdocumentiscancelled", F.lit(False))
    )
    kept = headers.select(
        "billingdocument", "soldtoparty", amount(F.col("totalnetamount")).alias("total_net_amount"), "billingdocumentdate"
    )
    return _without(kept, tables["billing_document_cancellations"], "billingdocument")


def order_milestones(tables: Collections) -> DataFrame:
    """``(salesorder, created_on, invoiced_on, first_paid_on, last_paid_on)`` of every order.

    Dates are aggregated per invoice, then per delivery, then per order.
    """
    paid = (
        _posted_payments(tables)
        .groupBy("accountingdocument")
        .agg(F.min("paid_on").alias("first_paid_on"), F.max("paid_on").alias("last_paid_on"))
    )
    invoices = tables["billing_document_headers"].select(
        "billingdocument", "accountingdocument", day(F.col("billingdocumentdate")).alias("invoiced_on")
    )
    per_invoice = invoices.join(paid, "accountingdocument", "left").drop("accountingdocument")
    dates = [
        F.min("invoiced_on").alias("invoiced_on"),
        F.min("first_paid_on").alias("first_paid_on"),
        F.max("last_paid_on").alias("last_paid_on"),
    ]
    per_delivery = (
        _invoice_of_delivery(tables).join(per_invoice, "billingdocument").groupBy("deliverydocument").agg(*dates)
    )
    per_order = _delivery_of_order(tables).join(per_delivery, "deliverydocument").groupBy("salesorder").agg(*dates)
    orders = tables["sales_order_headers"].select("salesorder", day(F.col("creationdate")).alias("created_on"))
    return orders.join(per_order, "salesorder", "left").select(
        "salesorder", "created_on", "invoiced_on", "first_paid_on", "last_paid_on"
    )


def slowest_orders(tables: Collections, as_of: datetime.date, limit: int = 5) -> DataFrame:
    """Orders created in the month of ``as_of`` by days to their last payment, or to ``as_of``."""
    first = as_of.replace(day=1)
    following = (first + datetime.timedelta(days=31)).replace(day=1)
    created = F.col("created_on")
    ranked = (
        order_milestones(tables)
        .filter((created >= F.lit(first)) & (created < F.lit(following)))
        .select(
            "salesorder",
            days_between(created, F.coalesce("last_paid_on", F.lit(as_of))).alias("o2c_days"),
            F.col("last_paid_on").isNull().alias("is_open"),
        )
    )
    return ranked.orderBy(F.desc("o2c_days"), F.asc("salesorder")).limit(limit)


def overdue_orders(
    tables: Collections, as_of: datetime.date, days: int = OVERDUE_DAYS, complete_status: str = COMPLETE_STATUS
) -> DataFrame:
    """Orders created more than ``days`` before ``as_of`` that are not complete."""
    created = day(F.col("creationdate"))
    return (
        tables["sales_order_headers"]
        .filter(F.col("overalldeliverystatus") != complete_status)
        .filter(created < F.lit(as_of - datetime.timedelta(days=days)))
        .select("salesorder", created.alias("created_on"), days_between(created, F.lit(as_of)).alias("age_days"))
    )


def lead_times(tables: Collections) -> DataFrame:
    """Days from order to first invoice, from there to first payment, and in total."""
    created, invoiced, paid = F.col("created_on"), F.col("invoiced_on"), F.col("first_paid_on")
    return order_milestones(tables).select(
        "salesorder",
        days_between(created, invoiced).alias("days_to_invoice"),
        days_between(invoiced, paid).alias("days_to_payment"),
        days_between(created, paid).alias("total_o2c_days"),
    )


def product_plant_density(tables: Collections) -> DataFrame:
    """Share of all product and plant combinations that exist."""

    def distinct_count(collection: str, *columns: str) -> DataFrame:
        return tables[collection].select(*columns).dropna().distinct().agg(F.count("*").alias("n"))

    products, plants = distinct_count("products", "product"), distinct_count("plants", "plant")
    counted = distinct_count("product_plants", "product", "plant").select(
        F.col("n").alias("pairs"), products.scalar().alias("products"), plants.scalar().alias("plants")
    )
    possible = F.col("products") * F.col("plants")
    return counted.select(
        "pairs",
        "products",
        "plants",
        F.round(F.when(possible > 0, F.col("pairs") / possible * 100), 4).alias("density_pct"),
    )


def storage_by_plant(tables: Collections) -> DataFrame:
    """Storage rows, products and storage locations per plant."""
    return tables["product_storage_locations"].groupBy("plant").agg(
        F.count("*").alias("storage_rows"),
        F.countDistinct("product").alias("products"),
        F.countDistinct("storagelocation").alias("storage_locations"),
    )
