"""The collections of an order-to-cash dataset."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Collection(NamedTuple):
    key: tuple[str, ...]
    columns: tuple[str, ...]


def _collection(key: str, columns: str = "") -> Collection:
    return Collection(tuple(key.split()), tuple(f"{key} {columns}".split()))


# Collection names, their keys and the columns the operators use,
# spelled as in the source records.
COLLECTIONS: dict[str, Collection] = {
    "sales_order_headers": _collection(
        "salesOrder",
        "salesOrderType soldToParty creationDate totalNetAmount transactionCurrency "
        "overallDeliveryStatus overallOrdReltdBillgStatus",
    ),
    "sales_order_items": _collection(
        "salesOrder salesOrderItem",
        "material requestedQuantity requestedQuantityUnit netAmount transactionCurrency productionPlant",
    ),
    "outbound_delivery_headers": _collection(
        "deliveryDocument",
        "creationDate creationTime actualGoodsMovementDate actualGoodsMovementTime "
        "overallGoodsMovementStatus shippingPoint",
    ),
    "outbound_delivery_items": _collection(
        "deliveryDocument deliveryDocumentItem",
        "actualDeliveryQuantity referenceSdDocument referenceSdDocumentItem plant storageLocation",
    ),
    "billing_document_headers": _collection(
        "billingDocument",
        "billingDocumentType creationDate creationTime billingDocumentDate billingDocumentIsCancelled "
        "totalNetAmount transactionCurrency accountingDocument soldToParty",
    ),
    "billing_document_items": _collection(
        "billingDocument billingDocumentItem",
        "material billingQuantity netAmount transactionCurrency referenceSdDocument referenceSdDocumentItem",
    ),
    "billing_document_cancellations": _collection(
        "billingDocument cancelledBillingDocument", "billingDocumentIsCancelled"
    ),
    "journal_entry_items_accounts_receivable": _collection(
        "accountingDocument accountingDocumentItem",
        "referenceDocument customer postingDate amountInTransactionCurrency transactionCurrency clearingDate",
    ),
    "payments_accounts_receivable": _collection(
        "accountingDocument accountingDocumentItem",
        "customer clearingDate amountInTransactionCurrency transactionCurrency clearingAccountingDocument",
    ),
    "business_partners": _collection(
        "businessPartner", "businessPartnerFullName businessPartnerName businessPartnerCategory"
    ),
    "business_partner_addresses": _collection(
        "addressId", "businessPartner streetName cityName postalCode country"
    ),
    "products": _collection("product", "productType productGroup baseUnit"),
    "product_descriptions": _collection("product language", "productDescription"),
    "plants": _collection(
        "plant",
        "plantName addressId plantCategory factoryCalendar salesOrganization distributionChannel division",
    ),
    "product_plants": _collection("product plant"),
    "product_storage_locations": _collection("product plant storageLocation"),
    "customer_company_assignments": _collection("customer companyCode", "paymentTerms"),
    "customer_sales_area_assignments": _collection(
        "customer salesOrganization distributionChannel division", "currency"
    ),
    "sales_order_schedule_lines": _collection(
        "salesOrder salesOrderItem scheduleLine", "confirmedDeliveryDate confdOrderQtyByMatlAvailCheck"
    ),
}

# Collections loaded by an ingest; all but the optional ones must exist.
CORE_COLLECTIONS = (
    "sales_order_headers",
    "sales_order_items",
    "outbound_delivery_headers",
    "outbound_delivery_items",
    "billing_document_headers",
    "billing_document_items",
    "business_partners",
    "products",
    "plants",
    "journal_entry_items_accounts_receivable",
    "payments_accounts_receivable",
    "business_partner_addresses",
)
OPTIONAL_COLLECTIONS = (
    "journal_entry_items_accounts_receivable",
    "payments_accounts_receivable",
    "business_partner_addresses",
)

BOOLEAN_COLUMNS = {"billingdocumentiscancelled"}

# Item collections get a helper key made of (document column, item column).
ITEM_KEYS = {
    "sales_order_items": ("salesorder", "salesorderitem"),
    "outbound_delivery_items": ("deliverydocument", "deliverydocumentitem"),
    "billing_document_items": ("billingdocument", "billingdocumentitem"),
}
ITEM_KEY_COLUMN = "_normalized_item_key"


def sanitize(name: str) -> str:
    """Column name of a source key."""
    return name.replace(" ", "_").replace("-", "_").lower()


def declared_type(column: str) -> str:
    return "boolean" if column in BOOLEAN_COLUMNS else "string"


def declared_columns(name: str) -> list[str]:
    return [sanitize(c) for c in COLLECTIONS[name].columns]


def key_columns(name: str) -> list[str]:
    return [sanitize(c) for c in COLLECTIONS[name].key]


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{c} {declared_type(c)}" for c in declared_columns(name)))


def complete(df: DataFrame, name: str) -> DataFrame:
    """Add declared columns the source lacks as nulls."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in declared_columns(name) if c not in have]
    return df.select("*", *[F.lit(None).cast(declared_type(c)).alias(c) for c in missing])


class Collections(Mapping[str, DataFrame]):
    """Collections by name, each built when first asked for.

    A collection without a source is an empty table with its declared columns.
    ``keyed`` tells of collections in which no two rows agree in all columns of
    their key (documents, and item numbers of six characters), nulls being values
    like any other, whatever the source holds.
    """

    def __init__(
        self,
        spark: SparkSession,
        sources: Mapping[str, Callable[[], DataFrame] | DataFrame],
        keyed: Mapping[str, Callable[[], bool]] | None = None,
    ):
        self.spark = spark
        self._sources = dict(sources)
        self._keyed = dict(keyed or {})
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in COLLECTIONS:
            raise KeyError(name)
        if name not in self._built:
            source = self._sources.get(name)
            df = source() if callable(source) else source
            self._built[name] = empty(self.spark, name) if df is None else complete(df, name)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(COLLECTIONS)

    def __len__(self) -> int:
        return len(COLLECTIONS)

    def keyed(self, *names: str) -> bool:
        """Whether all the collections are known to have no two rows with one key."""
        return all(name in self._keyed and self._keyed[name]() for name in names)

    def available(self) -> list[str]:
        """Names that have a source."""
        return [name for name in COLLECTIONS if name in self._sources]
