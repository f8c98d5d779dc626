import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.session import build_session, release  # noqa: E402
from ledgerloom.sources.catalog import Collections, declared_columns, declared_type  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "ledgerloom-tests",
        master="local[4]",
        spark_sql_shuffle_partitions="4",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def make_tables(spark):
    """Collections from lists of dicts by collection name."""

    def make(**rows_by_name):
        sources = {}
        for name, rows in rows_by_name.items():
            columns = declared_columns(name)
            schema = ", ".join(f"{c} {declared_type(c)}" for c in columns)
            unknown = {k for row in rows for k in row} - set(columns)
            assert not unknown, unknown
            sources[name] = spark.createDataFrame([tuple(row.get(c) for c in columns) for row in rows], schema)
        return Collections(spark, sources)

    return make


@pytest.fixture(scope="session")
def messy_flow(make_tables):
    """A small random flow with missing values, repeats and several spellings, as (rows, tables)."""
    pick = random.Random(7)
    documents, items = ["1", "2", "3", "4", None, ""], ["10", "000010", "20", " 20", "1234567", "1234568", None, ""]

    def some(*values):
        return pick.choice(values)

    rows = {
        "sales_order_headers": [
            {"salesorder": some("1", "2", "3", "5", None), "soldtoparty": some("c1", "c2", None)} for _ in range(9)
        ],
        "sales_order_items": [
            {"salesorder": some(*documents), "salesorderitem": some(*items), "material": some("m1", "m2", None)}
            for _ in range(40)
        ],
        "outbound_delivery_items": [
            {
                "deliverydocument": some("d1", "d2", "d3", None, ""),
                "deliverydocumentitem": some(*items),
                "referencesddocument": some(*documents),
                "referencesddocumentitem": some(*items),
                "plant": some("p1", "p2", None),
                "actualdeliveryquantity": some("1", "2"),
            }
            for _ in range(40)
        ],
        "billing_document_headers": [
            {
                "billingdocument": document,
                "accountingdocument": some("a1", "a2", "a3", None, ""),
                "soldtoparty": some("c1", "", None),
            }
            for document in ("b1", "b2", "b3", "b4", "b6")
        ],
        "billing_document_items": [
            {
                "billingdocument": some("b1", "b2", "b3", "b5", None),
                "billingdocumentitem": some(*items),
                "material": some("m1", "m2", "", None),
                "referencesddocument": some("d1", "d2", "d4", None, ""),
                "referencesddocumentitem": some(*items),
                "billingquantity": some("1", "2"),
            }
            for _ in range(40)
        ],
        "journal_entry_items_accounts_receivable": [
            {"accountingdocument": some("a1", "a2", None), "accountingdocumentitem": some("1", "2", None)}
            for _ in range(8)
        ],
        "payments_accounts_receivable": [
            {
                "accountingdocument": some("x1", "x2", "x3"),
                "clearingaccountingdocument": some("a1", "a2", "a9", None),
                "clearingdate": some("2025-01-01", None),
            }
            for _ in range(8)
        ],
    }
    return rows, make_tables(**rows)
