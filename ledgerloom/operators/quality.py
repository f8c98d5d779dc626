"""Profiles of collections and coverage of the joins between them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.keys import coverage_key, plain_key, spelled
from ledgerloom.sources.catalog import ITEM_KEY_COLUMN, Collections, sanitize

# Least coverage in percent of each class, best first.
CONFIRMED, PARTIAL, UNCERTAIN = 95, 80, 50
# Name parts of likely keys, and the least share of distinct values.
KEY_NAME_PARTS = ("id", "key", "number", "document", "order")
KEY_SHARE = 0.8
# Hashes a sketch keeps, as a power of two, and the estimate up to which it surely holds all of them.
SKETCH_BITS = 12
EXACT = 1 << (SKETCH_BITS - 1)
MISSING_DATA = "Missing collection data"


class JoinSpec(NamedTuple):
    """A join to measure, on one or two columns a side."""

    left: str
    left_keys: tuple[str, ...]
    right: str
    right_keys: tuple[str, ...]
    normalize: bool = True

    @property
    def name(self) -> str:
        return f"{_side(self.left, self.left_keys)} -> {_side(self.right, self.right_keys)}"

    @property
    def condition(self) -> str:
        pairs = zip(self.left_keys, self.right_keys)
        return " AND ".join(f"{self.left}.{a} = {self.right}.{b}" for a, b in pairs)


def _side(collection: str, keys: tuple[str, ...]) -> str:
    return f"{collection}.{keys[0]}" if len(keys) == 1 else f"{collection}.({', '.join(keys)})"


# The joins of the order-to-cash flow.
FLOW_JOINS = (
    JoinSpec("sales_order_headers", ("salesOrder",), "sales_order_items", ("salesOrder",)),
    JoinSpec(
        "sales_order_items",
        ("salesOrder", "salesOrderItem"),
        "outbound_delivery_items",
        ("referenceSdDocument", "referenceSdDocumentItem"),
    ),
    JoinSpec(
        "outbound_delivery_items",
        ("deliveryDocument", "deliveryDocumentItem"),
        "billing_document_items",
        ("referenceSdDocument", "referenceSdDocumentItem"),
    ),
    JoinSpec(
        "billing_document_headers",
        ("accountingDocument",),
        "journal_entry_items_accounts_receivable",
        ("accountingDocument",),
    ),
    JoinSpec(
        "journal_entry_items_accounts_receivable",
        ("accountingDocument",),
        "payments_accounts_receivable",
        ("clearingAccountingDocument",),
    ),
    JoinSpec("sales_order_headers", ("soldToParty",), "business_partners", ("businessPartner",)),
    JoinSpec("sales_order_items", ("material",), "products", ("product",)),
    JoinSpec("outbound_delivery_items", ("plant",), "plants", ("plant",)),
    JoinSpec(
        "business_partners", ("businessPartner",), "business_partner_addresses", ("businessPartner",)
    ),
    JoinSpec("plants", ("addressId",), "business_partner_addresses", ("addressId",)),
)


def _keys(tables: Collections, number: int, spec: JoinSpec, left: bool) -> DataFrame:
    collection, names = (spec.left, spec.left_keys) if left else (spec.right, spec.right_keys)
    form = coverage_key if spec.normalize else plain_key
    keys = [form(F.col(sanitize(name))) for name in names]
    second = keys[1] if len(keys) > 1 else F.lit("")
    return tables[collection].select(
        F.lit(number).alias("join_number"),
        keys[0].alias("key_1"),
        second.alias("key_2"),
        F.lit(1 if left else 0).cast("bigint").alias("left_row"),
        F.lit(0 if left else 1).cast("bigint").alias("right_row"),
    )


def _rows_per_key(tables: Collections, specs: Sequence[JoinSpec]) -> DataFrame:
    """Rows of both sides per join (its place among ``specs``) and key.

    All sides of all joins go through one grouping with partial aggregation; a
    key with very many rows arrives as few.
    """
    sides = [_keys(tables, k, spec, left) for k, spec in enumerate(specs) for left in (True, False)]
    return (
        reduce(DataFrame.unionByName, sides)
        .groupBy("join_number", "key_1", "key_2")
        .agg(F.sum("left_row").alias("left_rows"), F.sum("right_row").alias("right_rows"))
    )


def list_joins(tables: Collections, specs: Sequence[JoinSpec] = FLOW_JOINS) -> DataFrame:
    """``(left_table, right_table, condition, cardinality)`` of each join.

    The cardinality, such as ``1:N``, says whether any key repeats on a side.
    """
    most = _rows_per_key(tables, specs).groupBy("join_number").agg(
        F.max("left_rows").alias("most_left"), F.max("right_rows").alias("most_right")
    )
    wanted = tables.spark.createDataFrame(
        [(k, spec.left, spec.right, spec.condition) for k, spec in enumerate(specs)],
        "join_number int, left_table string, right_table string, condition string",
    )

    def side(column: str, many: str) -> Column:
        return F.when(F.col(column) > 1, many).otherwise("1")

    both = (F.col("most_left") > 1) & (F.col("most_right") > 1)
    return wanted.join(most, "join_number", "left").select(
        "left_table",
        "right_table",
        "condition",
        F.when(both, "N:M").otherwise(
            F.concat(side("most_left", "N"), F.lit(":"), side("most_right", "N"))
        ).alias("cardinality"),
    )


def join_coverage(tables: Collections, specs: Sequence[JoinSpec] = FLOW_JOINS) -> DataFrame:
    """Distinct keys of both sides of each join, how many match, and a class for the share."""
    per_key = _rows_per_key(tables, specs)
    in_left, in_right = F.col("left_rows") > 0, F.col("right_rows") > 0
    measured = per_key.groupBy("join_number").agg(
        F.sum("left_rows").alias("left_count"),
        F.sum("right_rows").alias("right_count"),
        F.count_if(in_left).alias("left_keys"),
        F.count_if(in_right).alias("right_keys"),
        F.count_if(in_left & in_right).alias("matching"),
    )
    wanted = tables.spark.createDataFrame(
        [(k, spec.name, spec.normalize) for k, spec in enumerate(specs)],
        "join_number int, join_path string, normalized boolean",
    )
    joined = wanted.join(measured, "join_number", "left").na.fill(0)
    empty = (F.col("left_count") == 0) | (F.col("right_count") == 0)
    share = F.when(empty, F.lit(0.0)).otherwise(F.col("matching") / F.col("left_keys") * 100)
    matched = F.when(empty, F.lit(0).cast("bigint")).otherwise(F.col("matching"))

    def unmatched(rows: str, keys: str) -> Column:
        return F.when(empty, F.col(rows)).otherwise(F.col(keys) - F.col("matching"))

    return joined.select(
        "join_path",
        "left_count",
        "right_count",
        "left_keys",
        "right_keys",
        matched.alias("matched"),
        unmatched("left_count", "left_keys").alias("unmatched_left"),
        unmatched("right_count", "right_keys").alias("unmatched_right"),
        F.round(share, 2).alias("coverage_pct"),
        F.when(empty, "not_recommended")
        .when(share >= CONFIRMED, F.when(F.col("normalized"), "confirmed_with_normalization").otherwise("confirmed"))
        .when(share >= PARTIAL, "partial")
        .when(share >= UNCERTAIN, "uncertain")
        .otherwise("not_recommended")
        .alias("classification"),
        F.when(empty, MISSING_DATA).otherwise("").alias("issues"),
    )


def _source_fields(df: DataFrame) -> list[T.StructField]:
    """Columns of the records themselves, without the helper key."""
    return [field for field in df.schema.fields if field.name.lower() != ITEM_KEY_COLUMN]


def column_profile(tables: Collections, names: Iterable[str]) -> DataFrame:
    """``(collection, column, data_type, rows, non_null)``, one pass per collection."""
    parts = []
    for name in names:
        df, fields = tables[name], _source_fields(tables[name])
        counted = df.agg(
            F.count("*").alias("rows"), *[F.count(F.col(f"`{f.name}`")).alias(f"n_{i}") for i, f in enumerate(fields)]
        )
        columns = [
            F.struct(
                F.lit(field.name.lower()).alias("column"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.col(f"n_{i}").alias("non_null"),
            )
            for i, field in enumerate(fields)
        ]
        parts.append(counted.select(F.lit(name).alias("collection"), "rows", F.inline(F.array(*columns))))
    return reduce(DataFrame.unionByName, parts).select("collection", "column", "data_type", "rows", "non_null")


def collection_profile(tables: Collections, names: Iterable[str]) -> DataFrame:
    """``(collection, row_count, columns)`` with the column names in order; names come from the schema."""
    parts = []
    for name in names:
        columns = ", ".join(sorted(field.name.lower() for field in _source_fields(tables[name])))
        counted = tables[name].agg(F.count("*").alias("row_count"))
        parts.append(counted.select(F.lit(name).alias("collection"), "row_count", F.lit(columns).alias("columns")))
    return reduce(DataFrame.unionByName, parts)


def sample_records(tables: Collections, names: Iterable[str]) -> DataFrame:
    """``(collection, sample)`` with the first record of each collection, by its columns in order of name, as JSON text."""
    parts = []
    for name in names:
        columns = sorted(tables[name].columns)
        # Nulls last: whether a value is missing is compared before the value.
        order = F.struct(*[x for i, c in enumerate(columns) for x in (F.col(c).isNull().alias(f"m_{i}"), F.col(c).alias(f"v_{i}"))])
        first = tables[name].agg(F.min(order).alias("first")).filter("first is not null")
        record = F.to_json(
            F.struct(*[F.col("first")[f"v_{i}"].alias(c) for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}
        )
        parts.append(first.select(F.lit(name).alias("collection"), record.alias("sample")))
    return reduce(DataFrame.unionByName, parts)


def inventory(tables: Collections, names: Iterable[str]) -> DataFrame:
    """Rows per collection with a TOTAL row."""
    counts = [
        tables[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("collection"), "rows") for name in names
    ]
    return (
        reduce(DataFrame.unionByName, counts)
        .rollup("collection")
        .agg(F.grouping("collection").alias("is_total"), F.sum("rows").alias("rows"))
        .select(F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("collection")).alias("collection"), "rows")
    )


def _likely_keys(tables: Collections, names: Iterable[str]) -> dict[str, list[str]]:
    """Columns named like keys, by collection."""
    found = {}
    for name in names:
        columns = [field.name for field in _source_fields(tables[name])]
        found[name] = [c for c in columns if any(part in c.lower() for part in KEY_NAME_PARTS)]
    return {name: columns for name, columns in found.items() if columns}


def _sketched(tables: Collections, likely: dict[str, list[str]]) -> DataFrame:
    """``(collection, column, rows, estimate)`` by bottom-k sketches: one pass per collection, a row per task is shuffled."""
    parts = []
    for name, columns in likely.items():
        sketches = [
            F.theta_sketch_estimate(F.theta_sketch_agg(spelled(F.col(f"`{c}`")), F.lit(SKETCH_BITS))).alias(f"n_{i}")
            for i, c in enumerate(columns)
        ]
        counted = tables[name].agg(F.count("*").alias("rows"), *sketches)
        values = [F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("estimate")) for i, c in enumerate(columns)]
        parts.append(counted.select(F.lit(name).alias("collection"), "rows", F.inline(F.array(*values))))
    return reduce(DataFrame.unionByName, parts)


def _counted(tables: Collections, columns: list[tuple[str, str]]) -> DataFrame:
    """``(collection, column, rows, distinct_values)`` of some columns, exact by one shuffle of their values."""
    parts = []
    for name in dict.fromkeys(name for name, _ in columns):
        values = [
            F.struct(F.lit(c.lower()).alias("column"), spelled(F.col(f"`{c}`")).alias("value"))
            for own, c in columns
            if own == name
        ]
        parts.append(tables[name].select(F.lit(name).alias("collection"), F.inline(F.array(*values))))
    per_value = reduce(DataFrame.unionByName, parts).groupBy("collection", "column", "value").agg(F.count("*").alias("n"))
    return per_value.groupBy("collection", "column").agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct_values")
    )


def column_distinct(tables: Collections, names: Iterable[str], least_share: float = 0.0) -> DataFrame:
    """``(collection, column, rows, distinct_values)`` of the columns named like keys, exactly.

    Missing values count as one value. Sketches of the smallest hashes come first:
    one that is far from full holds all distinct values and is the exact count. Only
    columns with more values are stacked into rows and shuffled by value. With
    ``least_share`` columns whose distinct values are surely no such share of the rows
    (by a tenth, some six standard errors of a sketch) are left out.
    """
    likely = _likely_keys(tables, names)
    if not likely:
        schema = "collection string, column string, rows bigint, distinct_values bigint"
        return tables.spark.createDataFrame([], schema)
    # One row per column.
    told = [tuple(r) for r in _sketched(tables, likely).select("collection", "column", "rows", "estimate").collect()]
    told = [r for r in told if r[2] and r[3] * 1.1 >= r[2] * least_share]
    exact = [(name, c.lower(), rows, n) for name, c, rows, n in told if n <= EXACT]
    schema = "collection string, column string, rows bigint, distinct_values bigint"
    found = tables.spark.createDataFrame(exact, schema)
    many = [(name, c) for name, c, _, n in told if n > EXACT]
    return found.unionByName(_counted(tables, many)) if many else found


def key_candidates(tables: Collections, names: Iterable[str]) -> DataFrame:
    """Columns named like keys whose values are mostly distinct."""
    measured = column_distinct(tables, names, KEY_SHARE)
    return measured.filter(F.col("distinct_values") > F.col("rows") * KEY_SHARE)


def shared_columns(tables: Collections, names: Iterable[str]) -> DataFrame:
    """``(column, collections, appearances, filled_values)`` of columns in several collections."""
    grouped = column_profile(tables, names).groupBy("column").agg(
        F.array_join(F.array_sort(F.collect_set("collection")), ", ").alias("collections"),
        F.countDistinct("collection").alias("appearances"),
        F.sum("non_null").alias("filled_values"),
    )
    return grouped.filter(F.col("appearances") > 1)
