import json

import pytest

from ledgerloom.operators import flows, prompts
from ledgerloom.operators.trace import Trace

# prompt, intent, needs clarification
CASES = [
    ("Which products are associated with the highest number of billing documents?", "top_products", False),
    ("Show me the top 5 products by billing count", "top_products", False),
    ("show me the top 5 products", "graph_explore", True),
    ("Show me all broken flows", "broken_flows", False),
    ("Trace billing document 90504248", "error", False),
    ("Trace billing document 91150175", "trace_billing_flow", False),
    ("trace 91150175, which invoice?", "trace_billing_flow", False),
    ("Trace a billing document", "trace_billing_flow", True),
    ("trace invoice 90504248", "unknown", True),
    ("Explore the graph", "out_of_domain", False),
    ("What's the weather today?", "out_of_domain", False),
    ("Who won the Super Bowl?", "out_of_domain", False),
    ("Tell me a joke", "out_of_domain", False),
    ("hello", "out_of_domain", False),
    ("", "unknown", True),
    ("  \n", "unknown", True),
    (None, "unknown", True),
    ("List sales orders that are INCOMPLETE", "broken_flows", False),
    ("Which order weather game rain sunny", "out_of_domain", False),
    ("how are you, order?", "unknown", True),
    ("highest 0 products by billing", "top_products", False),
    ("top 99999999999999999999999999999999999999999 products by billing", "top_products", False),
]


@pytest.fixture(scope="module")
def tables(make_tables):
    return make_tables(
        billing_document_headers=[
            {"billingdocument": "91150175", "accountingdocument": "a", "soldtoparty": "320000083"},
            {"billingdocument": "b2"},
        ],
        journal_entry_items_accounts_receivable=[{"accountingdocument": "a", "accountingdocumentitem": "1"}],
        billing_document_items=[
            {"billingdocument": "b2", "billingdocumentitem": str(i), "material": m, "referencesddocument": "d"}
            for i, m in enumerate("mmn")
        ] + [{"billingdocument": "b3", "billingdocumentitem": "1", "material": "n"}],
        outbound_delivery_items=[{"deliverydocument": "d9", "deliverydocumentitem": "1"}],
        sales_order_headers=[{"salesorder": "s1"}],
    )


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "prompt_id int, prompt string")


@pytest.fixture(scope="module")
def answers(asked, tables):
    return {r["prompt"]: r for r in prompts.answer(asked, tables).collect()}


def test_intents(answers):
    got = [(p, answers[p]["intent"], answers[p]["requires_clarification"]) for p, _, _ in CASES]
    assert got == CASES


def test_reasons(asked):
    got = {r["prompt"]: (r["in_domain"], r["reason"]) for r in prompts.guard(asked).collect()}
    assert got["Which order weather game rain sunny"] == (
        False, "Query contains out-of-domain keywords: game, rain, sunny")
    assert got["hello"] == (False, "Query does not match known in-domain patterns")
    assert got[""] == got[None] == (False, "Empty query")
    assert got["Show me all broken flows"] == (True, "Query contains in-domain keywords")


def test_words_of_any_script(spark):
    df = spark.createDataFrame([("órder",), ("order x",), ("ORDER!",), ("re-order",), ("sales_order",), ("²order",)], "prompt string")
    got = [r["in_domain"] for r in prompts.guard(df).collect()]
    assert got == [False, True, True, True, True, False]


def test_document_ids(spark):
    texts = ["trace 1234567", "trace 12345678 87654321", "x12345678", "é12345678", "(12345678)", "123456789012"]
    df = spark.createDataFrame([(t,) for t in texts], "prompt string")
    got = [r["billing_document_id"] for r in prompts.classify(df).collect()]
    assert got == [None, "12345678", None, None, "12345678", "123456789012"]


def test_answer_texts(answers):
    top = answers["Show me the top 5 products by billing count"]
    assert top["answer_text"] == (
        "The top product is 'n' with 2 billing documents. Here are the top 2 products by billing document count.")
    assert top["cited_ids"] == ["n", "m"] and top["cited_node_ids"] == ["product_n", "product_m"]
    assert answers["highest 0 products by billing"]["answer_text"] == "No products found in the dataset."
    assert answers["highest 0 products by billing"]["cited_ids"] == []
    assert "top 2 products" in answers[CASES[-1][0]]["answer_text"]
    broken = answers["Show me all broken flows"]
    assert broken["answer_text"].splitlines() == [
        "Found 4 broken flows in the O2C process:", "- 1 deliveries not billed",
        "- 2 billing docs without delivery", "- 1 sales orders with no downstream flow"]
    assert broken["cited_ids"] == ["d9", "b2", "b3", "s1"]
    assert broken["cited_node_ids"] == ["delivery_d9", "billingdocument_b2", "billingdocument_b3", "salesorder_s1"]
    traced = answers["Trace billing document 91150175"]
    assert traced["answer_text"].splitlines() == [
        "Traced billing document 91150175:", "- Customer: 320000083", "- Billing Items: 0", "- Delivery Items: 0",
        "- Sales Order Items: 0", "- Posted to Journal Entry: Yes"]
    assert answers["Trace billing document 90504248"]["answer_text"] == (
        "An error occurred processing your query: trace query failed: Billing document 90504248 not found.")
    assert json.loads(top["cited_data_summary"]) == {
        "limit": 5,
        "results": [{"product": "n", "billing_document_count": 2}, {"product": "m", "billing_document_count": 1}],
    }
    assert json.loads(broken["cited_data_summary"])["billed_without_delivery"] == {"count": 2, "sample_ids": ["b2", "b3"]}
    assert json.loads(traced["cited_data_summary"]) == {"nodes": 3, "edges": 2}
    assert answers["hello"]["cited_data_summary"] == "{}"
    assert json.loads(answers["highest 0 products by billing"]["cited_data_summary"]) == {"count": 0}
    assert answers[""]["answer_text"] == "Please provide a question or query."
    assert answers["trace invoice 90504248"]["answer_text"].startswith("I'm not sure what you're asking.")


def test_references(asked, tables):
    got = prompts.trace_references(asked, tables).collect()
    assert {(r["billing_document_id"], r["kind"]) for r in got} == {("91150175", "node"), ("91150175", "edge")}
    assert len(got) == 5


def test_no_products(spark, make_tables):
    df = spark.createDataFrame([("top product?",), ("broken flows",)], "prompt string")
    got = {r["intent"]: r for r in prompts.answer(df, make_tables()).collect()}
    assert got["top_products"]["answer_text"] == prompts.ANSWER_NO_PRODUCTS
    assert got["top_products"]["cited_ids"] == [] and got["broken_flows"]["cited_ids"] == []
    assert got["broken_flows"]["answer_text"].startswith("Found 0 broken flows")
    assert flows.SAMPLE_SIZE == 20


def test_answers_take_facts_and_sizes_of_traces_in_one_pass(spark, tables, monkeypatch):
    passes, links = [], Trace.links
    monkeypatch.setattr(Trace, "links", lambda trace, kinds: passes.append(kinds) or links(trace, kinds))
    asked = spark.createDataFrame([("p", "Trace billing document 91150175")], "prompt_id string, prompt string")
    answered = prompts.answer(asked, tables).first()
    assert len(passes) == 1
    sizes = Trace(tables).summary().filter("billing_document_id = '91150175'").first()
    assert json.loads(answered.cited_data_summary) == {"nodes": sizes.nodes, "edges": sizes.edges}
