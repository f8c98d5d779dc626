"""Routing of a table of prompts to the flow reports.

A prompt is checked against the domain words, given an intent and its numbers,
and answered from the same reports that users query directly. Reports without
per-prompt input (ranking, broken flows) join as one bounded row; traces join by
document id. The ids a trace answer refers to can be many and are shared by all
prompts on the document, so they are a table of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import flows
from ledgerloom.operators.trace import DOCUMENT, Trace, trace_facts
from ledgerloom.session import stage
from ledgerloom.sources.catalog import Collections

# Domain words, matched against whole words of a prompt.
IN_DOMAIN = (
    "product products material materials sku billing flow flows broken incomplete missing delivered billed "
    "delivery invoice document documents order orders count sales payment trace which what show list rank "
    "highest lowest top sales_order billing_document outbound_delivery journal_entry accounts_receivable "
    "outstanding overdue reconcile ledger downstream upstream lineage path connection"
).split()
OUT_OF_DOMAIN = (
    "weather temperature rain sunny cloud forecast score game team player championship league match news "
    "headline breaking election war president movie music actor singer episode season capital population "
    "history author book poem joke funny laugh api rest function code programming python javascript stock "
    "crypto forex investment portfolio dividend"
).split()

# Phrases of each intent, matched anywhere in the lower-cased prompt.
TOP_PRODUCTS_PHRASES = ("top product", "highest billing", "most billing", "which product", "products by billing")
BROKEN_FLOWS_PHRASES = (
    "broken",
    "incomplete",
    "delivered not billed",
    "delivered but not billed",
    "billed without delivery",
    "no downstream",
    "missing flow",
)
TRACE_PHRASES = ("trace billing", "trace document", "billing flow")
EXPLORE_PHRASES = ("explore", "show", "graph", "relationships", "connected")

# Patterns of the document id and of the requested number of products.
DOCUMENT_PATTERN = r"(?<![\p{L}\p{N}_])([0-9]{8,})(?![\p{L}\p{N}_])"
LIMIT_PATTERN = r"(?U)(?:top|highest|first)\s+([0-9]+)"

# Intents and reasons.
TOP_PRODUCTS, BROKEN_FLOWS, TRACE = "top_products", "broken_flows", "trace_billing_flow"
EXPLORE, UNKNOWN, REJECTED, ERROR = "graph_explore", "unknown", "out_of_domain", "error"
REASON_OUT = "Query contains out-of-domain keywords: "
REASON_IN = "Query contains in-domain keywords"
REASON_NEUTRAL = "Query does not match known in-domain patterns"
REASON_EMPTY = "Empty query"

# Answer texts.
ANSWER_EMPTY = "Please provide a question or query."
ANSWER_REJECTED = "This system is designed to answer questions related to the provided dataset only."
ANSWER_EXPLORE = (
    "Graph exploration queries are not yet supported. "
    "Try asking about top products, broken flows, or trace a billing document."
)
ANSWER_WHICH_DOCUMENT = (
    "Which billing document would you like me to trace? Please provide a billing document ID."
)
ANSWER_UNKNOWN = (
    "I'm not sure what you're asking. Try asking about:\n"
    "- Top products by billing document count\n"
    "- Broken flows in the O2C process\n"
    "- Trace a specific billing document (e.g., '90504248')"
)
ANSWER_NO_PRODUCTS = "No products found in the dataset."

CITED_PRODUCTS = 10
LISTED_PRODUCTS = 50
CITED_FLOWS = 50
FLOW_NODE_PREFIXES = ("delivery", "billingdocument", "salesorder")


def words(prompt: Column) -> Column:
    """Distinct lower-case words: runs of letters, digits and ``_`` of any script."""
    text = F.regexp_replace(F.lower(prompt), r"[^\p{L}\p{N}_]+", " ")
    return F.array_remove(F.array_distinct(F.split(text, " ")), "")


def _is_blank(prompt: Column) -> Column:
    return ~F.coalesce(prompt, F.lit("")).rlike(r"(?U)\S")


def _any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def _literals(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(word) for word in words])


def guard(prompts: DataFrame) -> DataFrame:
    """``prompts`` with ``in_domain`` and ``reason``; out-of-domain words win."""
    prompt = F.coalesce("prompt", F.lit(""))
    split = prompts.withColumn("_words", words(prompt))
    checked = split.withColumn("_out", F.array_sort(F.array_intersect("_words", _literals(OUT_OF_DOMAIN))))
    foreign = F.size("_out") > 0
    domestic = F.arrays_overlap("_words", _literals(IN_DOMAIN))
    reason = (
        F.when(foreign, F.concat(F.lit(REASON_OUT), F.array_join(F.slice("_out", 1, 3), ", ")))
        .when(domestic, REASON_IN)
        .when(F.size("_words") > 0, REASON_NEUTRAL)
        .otherwise(REASON_EMPTY)
    )
    return checked.select(*prompts.columns, (~foreign & domestic).alias("in_domain"), reason.alias("reason"))


def classify(prompts: DataFrame) -> DataFrame:
    """``prompts`` with the intent the phrases ask for and the numbers found.

    The domain check is not part of this; :func:`route` adds it.
    """
    prompt = F.coalesce("prompt", F.lit(""))
    read = prompts.withColumns(
        {"_text": F.lower(prompt), DOCUMENT: F.nullif(F.regexp_extract(prompt, DOCUMENT_PATTERN, 1), F.lit(""))}
    )
    text = F.col("_text")
    found_limit = F.nullif(F.regexp_extract(text, LIMIT_PATTERN, 1), F.lit(""))
    asks_trace = _any_of(text, TRACE_PHRASES) | text.contains(
        F.concat(F.lit("trace "), F.coalesce(DOCUMENT, F.lit("")))
    )
    intent = (
        F.when(_any_of(text, TOP_PRODUCTS_PHRASES), TOP_PRODUCTS)
        .when(_any_of(text, BROKEN_FLOWS_PHRASES), BROKEN_FLOWS)
        .when(asks_trace, TRACE)
        .when(_any_of(text, EXPLORE_PHRASES), EXPLORE)
        .otherwise(UNKNOWN)
    )
    return read.select(*prompts.columns, intent.alias("intent"), DOCUMENT, found_limit.alias("product_limit"))


def route(prompts: DataFrame) -> DataFrame:
    """``prompts`` with the final intent and whether the user must clarify."""
    classified = classify(guard(prompts))
    blank, rejected = _is_blank(F.col("prompt")), ~F.col("in_domain")
    accepted = ~blank & ~rejected
    intent = F.when(blank, UNKNOWN).when(rejected, REJECTED).otherwise(F.col("intent"))
    unclear = F.col("intent").isin(EXPLORE, UNKNOWN) | ((F.col("intent") == TRACE) & F.col(DOCUMENT).isNull())
    is_trace, is_ranking = accepted & (F.col("intent") == TRACE), accepted & (F.col("intent") == TOP_PRODUCTS)
    return classified.select(
        *prompts.columns,
        intent.alias("intent"),
        (blank | (accepted & unclear)).alias("requires_clarification"),
        F.when(is_trace, F.col(DOCUMENT)).alias(DOCUMENT),
        F.when(is_ranking, F.col("product_limit")).alias("product_limit"),
    )


def _ranking_facts(tables: Collections, most: int) -> tuple[Column, Column]:
    """The number of products, and the first ``most`` with their counts."""
    counted = stage(flows.products_by_billing(tables), "ranking")
    rank = F.struct((-F.col("billing_document_count")).alias("rank"), "product", "billing_document_count")
    first = counted.orderBy(F.desc("billing_document_count"), "product").limit(most)
    best = first.agg(F.array_sort(F.collect_list(rank)).alias("best"))
    return counted.agg(F.count("*").alias("products")).scalar(), best.scalar()


def _flow_facts(tables: Collections, sample: int, most: int) -> Column:
    """The three counts, the sampled ids in report order, and both as one object."""
    summary = flows.broken_flow_summary(tables, sample)

    def of(bucket: str, column: str) -> Column:
        return F.max(F.when(F.col("bucket") == bucket, F.col(column)))

    def prefixed(prefix: str) -> Callable[[Column], Column]:
        return lambda document: F.concat(F.lit(f"{prefix}_"), document)

    buckets = list(enumerate(flows.BUCKETS))
    row = summary.agg(
        *[of(bucket, "count").alias(f"flow_{i}") for i, bucket in buckets],
        *[of(bucket, "sample_ids").alias(f"sample_{i}") for i, bucket in buckets],
    )
    samples = F.concat(*[f"sample_{i}" for i, _ in buckets])
    node_ids = F.concat(*[F.transform(f"sample_{i}", prefixed(FLOW_NODE_PREFIXES[i])) for i, _ in buckets])
    cited = [F.struct(F.col(f"flow_{i}").alias("count"), F.col(f"sample_{i}").alias("sample_ids")).alias(b) for i, b in buckets]
    return row.select(
        F.struct(
            *[f"flow_{i}" for i, _ in buckets],
            F.slice(samples, 1, most).alias("flow_ids"),
            F.slice(node_ids, 1, most).alias("flow_node_ids"),
            F.to_json(F.struct(*cited)).alias("cited"),
        )
    ).scalar()


def _asked_documents(routed: DataFrame) -> DataFrame:
    """Document ids to trace, staged: a trace uses them several times."""
    return stage(routed.filter(F.col(DOCUMENT).isNotNull()).select(DOCUMENT).distinct(), "asked")


def _lines(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- {label}: "), value.cast("string"))


def _counted(value: str, label: str) -> Column:
    return F.concat(F.lit("- "), F.col(value).cast("string"), F.lit(f" {label}"))


def answer(
    prompts: DataFrame,
    tables: Collections,
    cited_products: int = CITED_PRODUCTS,
    cited_flows: int = CITED_FLOWS,
    sample: int = flows.SAMPLE_SIZE,
    listed_products: int = LISTED_PRODUCTS,
) -> DataFrame:
    """``prompts`` with intent, answer text, clarification flag, cited ids and the data behind them.

    ``cited_ids`` holds the bare ids of ranking (``cited_products`` at most) and
    broken-flow answers (``cited_flows`` at most, ``sample`` of each kind) and
    ``cited_node_ids`` the graph node ids they stand for. ``cited_data_summary`` is
    JSON text: the asked limit and the ranking rows (``listed_products`` at most),
    the three kinds of broken flows with counts and samples, or the sizes of a
    trace; ``{}`` for all other answers. The ids of a trace are in
    :func:`trace_references`. The routed prompts are staged: both the documents to
    trace and the answers read them.
    """
    routed = stage(route(prompts), "routed")
    asked = _asked_documents(routed)
    facts = trace_facts(tables, asked, sizes=True).withColumnRenamed(DOCUMENT, "traced")
    # Prompts that ask for no document would all share one key; a number made
    # from the row spreads them. Document ids are digits, so nothing meets it.
    spread = F.concat(F.lit("none-"), F.xxhash64(*prompts.columns).cast("string"))
    joined = (
        routed.withColumn("traced", F.coalesce(DOCUMENT, spread))
        .join(facts, "traced", "left")
    )
    products, best = _ranking_facts(tables, max(cited_products, listed_products))
    joined = joined.withColumns({"products": products, "best": best, "flow": _flow_facts(tables, sample, cited_flows)})
    joined = joined.select("*", "flow.*")

    wanted = F.coalesce(F.col("product_limit").try_cast("decimal(38,0)"), F.col("products").cast("decimal(38,0)"))
    limit = F.when(F.col("product_limit").isNull(), F.lit(flows.DEFAULT_LIMIT)).otherwise(wanted)
    listed = F.least(limit.cast("decimal(38,0)"), F.col("products").cast("decimal(38,0)")).cast("bigint")
    cited = F.slice("best", F.lit(1), F.least(listed, F.lit(cited_products)).cast("int"))
    leader = F.get("best", F.lit(0))
    ranking = F.when(listed == 0, ANSWER_NO_PRODUCTS).otherwise(
        F.concat(
            F.lit("The top product is '"),
            leader["product"],
            F.lit("' with "),
            leader["billing_document_count"].cast("string"),
            F.lit(" billing documents. Here are the top "),
            listed.cast("string"),
            F.lit(" products by billing document count."),
        )
    )
    broken = _lines(
        F.concat(
            F.lit("Found "),
            (F.col("flow_0") + F.col("flow_1") + F.col("flow_2")).cast("string"),
            F.lit(" broken flows in the O2C process:"),
        ),
        _counted("flow_0", "deliveries not billed"),
        _counted("flow_1", "billing docs without delivery"),
        _counted("flow_2", "sales orders with no downstream flow"),
    )
    traced = _lines(
        F.concat(F.lit("Traced billing document "), F.col(DOCUMENT), F.lit(":")),
        _labelled("Customer", F.coalesce("customer", F.lit("N/A"))),
        _labelled("Billing Items", F.col("billing_items")),
        _labelled("Delivery Items", F.col("delivery_items")),
        _labelled("Sales Order Items", F.col("sales_order_items")),
        _labelled("Posted to Journal Entry", F.when(F.col("journal_entries") > 0, "Yes").otherwise("No")),
    )
    not_found = F.concat(
        F.lit("An error occurred processing your query: trace query failed: Billing document "),
        F.col(DOCUMENT),
        F.lit(" not found."),
    )
    intent = F.col("intent")
    failed = (intent == TRACE) & F.col(DOCUMENT).isNotNull() & F.col("billing_items").isNull()
    text = (
        F.when(failed, not_found)
        .when(intent == TOP_PRODUCTS, ranking)
        .when(intent == BROKEN_FLOWS, broken)
        .when((intent == TRACE) & F.col(DOCUMENT).isNull(), ANSWER_WHICH_DOCUMENT)
        .when(intent == TRACE, traced)
        .when(intent == EXPLORE, ANSWER_EXPLORE)
        .when(intent == REJECTED, ANSWER_REJECTED)
        .when(_is_blank(F.col("prompt")), ANSWER_EMPTY)
        .otherwise(ANSWER_UNKNOWN)
    )
    rows = F.transform(
        F.slice("best", F.lit(1), F.least(listed, F.lit(listed_products)).cast("int")),
        lambda p: F.struct(p["product"].alias("product"), p["billing_document_count"].alias("billing_document_count")),
    )
    ranked = F.to_json(F.struct(limit.cast("decimal(38,0)").alias("limit"), rows.alias("results")))
    traced_sizes = F.to_json(F.struct("nodes", "edges"))
    cited_data = (
        F.when(failed, "{}")
        .when((intent == TOP_PRODUCTS) & (listed == 0), '{"count":0}')
        .when(intent == TOP_PRODUCTS, ranked)
        .when(intent == BROKEN_FLOWS, F.col("cited"))
        .when((intent == TRACE) & F.col(DOCUMENT).isNotNull(), traced_sizes)
        .otherwise("{}")
    )
    none = F.array().cast("array<string>")
    products = F.transform(cited, lambda p: p["product"])
    ids = F.when(intent == TOP_PRODUCTS, products).when(intent == BROKEN_FLOWS, F.col("flow_ids")).otherwise(none)
    return joined.select(
        *prompts.columns,
        F.when(failed, ERROR).otherwise(intent).alias("intent"),
        text.alias("answer_text"),
        "requires_clarification",
        F.when(~failed, F.col(DOCUMENT)).alias(DOCUMENT),
        ids.alias("cited_ids"),
        F.when(intent == TOP_PRODUCTS, F.transform(products, lambda p: F.concat(F.lit("product_"), p)))
        .when(intent == BROKEN_FLOWS, F.col("flow_node_ids"))
        .otherwise(none)
        .alias("cited_node_ids"),
        cited_data.alias("cited_data_summary"),
    )


def trace_references(prompts: DataFrame, tables: Collections) -> DataFrame:
    """``(billing_document_id, kind, ref_id)`` of the nodes and edges trace answers refer to."""
    return Trace(tables, _asked_documents(route(prompts))).references()
