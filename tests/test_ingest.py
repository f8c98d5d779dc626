import json
import os
import threading

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from ledgerloom.sources import ingest, jsonl
from ledgerloom.sources.catalog import COLLECTIONS, CORE_COLLECTIONS, sanitize


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines))


@pytest.fixture
def root(tmp_path):
    items = tmp_path / "sales_order_items"
    write(
        items / "part-1.jsonl",
        {"salesOrder": "1", "sales-Order Item": "10", "n": 1, "f": 1.5, "b": True, "t": {"hours": 1}},
        "",
        "   ",
        {"salesOrder": "2", "n": "12", "b": "false", "t": None},
    )
    write(
        items / "part-2.jsonl",
        {"salesOrder": 3, "n": 2.5, "f": "2", "b": False},
        {"salesOrder": "4", "extra": 1},
        {"salesOrder": "5", "n": "many"},
        {"salesOrder": "6", "b": "perhaps"},
        "not json",
        '{"salesOrder": "7"',
        "[1, 2]",
    )
    write(items / "notes.jsonl", {"salesOrder": "99"})
    write(tmp_path / "plants" / "plants.jsonl", {"plant": "p1"}, {"plant": "p2"})
    (tmp_path / "products").mkdir()
    return tmp_path


def test_column_names():
    assert sanitize("Sales-Order Item") == "sales_order_item"


def test_scan_types_rejects_and_helper_key(spark, root):
    source = jsonl.Source(spark, str(root / "sales_order_items"), "plain")
    assert (source.files, source.pattern) == (2, "part-*.jsonl")
    records = jsonl.scan(source)
    assert dict(records.dtypes) == {
        "salesorder": "string", "sales_order_item": "string", "n": "bigint", "f": "double", "b": "boolean",
        "t": "string", "_rejected": "boolean",
    }
    accepted = rows_of(records.filter("not _rejected").drop("_rejected"))
    assert accepted == sorted(
        [
            ("1", "10", 1, 1.5, True, '{"hours":1}'),
            ("2", None, 12, None, False, None),
            ("3", None, 2, 2.0, False, None),
        ],
        key=repr,
    )
    assert records.filter("_rejected").count() == 6
    assert jsonl.load_stats(records, "x").first().asDict() == {"collection": "x", "inserted": 3, "errors": 6}


def test_helper_key_of_item_collections(spark, tmp_path):
    write(
        tmp_path / "sales_order_items" / "part-1.jsonl",
        {"salesOrder": "1", "salesOrderItem": "10"},
        {"salesOrder": None, "salesOrderItem": " 20 "},
        {"salesOrder": "3"},
        {"salesOrder": "4", "salesOrderItem": "1234567"},
        {"salesOrder": "5", "salesOrderItem": "A"},
    )
    df = jsonl.read_collection(spark, str(tmp_path / "sales_order_items"), "sales_order_items")
    assert [r[0] for r in df.select("_normalized_item_key").collect()] == [
        "1_000010", "_000020", "3_", "4_1234567", "5_A",
    ]


def test_paths(spark, root):
    folder = str(root / "plants")
    for path in (folder, folder + ".jsonl", str(root), os.path.join(folder, "plants.jsonl")):
        if path == str(root):
            assert jsonl.resolve_path(spark, path + "/nowhere", "plants") == path + "/nowhere"
            continue
        assert jsonl.read_collection(spark, path, "plants").count() == 2
    assert jsonl.Source(spark, str(root / "products"), "products").files == 0
    assert jsonl.read_collection(spark, str(root / "products"), "products") is None
    assert jsonl.Source(spark, str(root / "missing"), "missing").sample() == {}


def test_ingest_is_a_full_refresh(spark, root, tmp_path):
    out = str(tmp_path / "out")
    names = ["sales_order_items", "plants", "products", "business_partners"]
    expected = [
        ("business_partners", 0, 0, 0), ("plants", 2, 0, 1), ("products", 0, 0, 0), ("sales_order_items", 3, 6, 2),
    ]
    for _ in range(2):
        assert rows_of(ingest.ingest(spark, str(root), out, names)) == expected
    assert rows_of(ingest.load_report(spark, str(root), names)) == expected
    tables = ingest.open_tables(spark, out)
    assert rows_of(tables["plants"], "plant", "plantname") == [("p1", None), ("p2", None)]
    assert tables["products"].columns == ["product", "producttype", "productgroup", "baseunit"]
    bad = ingest.open_rejected(spark, out)
    assert sorted((r["collection"], r["file"][-12:], r["line"], r["reason"]) for r in bad.collect()) == sorted(
        ("sales_order_items", "part-2.jsonl", line, reason)
        for line, reason in (
            ('{"salesOrder": "4", "extra": 1}', "unknown key: extra"),
            ('{"salesOrder": "5", "n": "many"}', "wrong value: n"),
            ('{"salesOrder": "6", "b": "perhaps"}', "wrong value: b"),
            ("not json", "not one JSON object"),
            ('{"salesOrder": "7"', "not one JSON object"),
            ("[1, 2]", "not one JSON object"),
        )
    )
    total = ingest.with_total(ingest.load_report(spark, str(root), names))
    assert rows_of(total, "collection", "inserted", "errors", "files", "status")[0] == ("TOTAL", 5, 6, 3, "warning")


def test_what_was_rejected_goes_with_the_next_ingest(spark, tmp_path):
    folder, out = tmp_path / "in" / "plants", str(tmp_path / "out")
    write(folder / "part-1.jsonl", {"plant": "p1"}, "{}", {"plant": "p2"})
    ingest.ingest(spark, str(tmp_path / "in"), out, ["plants"])
    assert rows_of(ingest.open_rejected(spark, out), "collection", "line", "reason") == [("plants", "{}", "no members")]
    (folder / "part-1.jsonl").unlink()
    write(folder / "part-2.jsonl", {"plant": "p1"})
    ingest.ingest(spark, str(tmp_path / "in"), out, ["plants"])
    assert ingest.open_rejected(spark, out).collect() == []


def test_missing_collections(spark, root):
    missing = ingest.missing_required(spark, str(root))
    assert "plants" not in missing and "sales_order_headers" in missing
    assert "payments_accounts_receivable" not in missing
    tables = ingest.open_dataset(spark, str(root))
    assert tables.available() == ["sales_order_items", "products", "plants"]
    status = {r["collection"]: r["status"] for r in ingest.collection_check(tables).collect()}
    assert status["plants"] == "ok"
    assert status["sales_order_headers"] == "missing"
    assert status["payments_accounts_receivable"] == "optional_missing"
    assert set(status) == set(CORE_COLLECTIONS)
    with pytest.raises(KeyError):
        tables["unknown"]


def test_schema_listing(make_tables):
    listed = ingest.list_schema(make_tables(plants=[{"plant": "1"}]), ["plants", "billing_document_headers"])
    got = {(r["collection"], r["column"]): (r["data_type"], r["is_key"]) for r in listed.collect()}
    assert got["plants", "plant"] == ("string", True)
    assert got["billing_document_headers", "billingdocumentiscancelled"] == ("boolean", False)
    assert len(COLLECTIONS) == 19


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None)], "x string, n int, e string")
    ingest.export(df, str(tmp_path / "c"), "csv")
    ingest.export(df, str(tmp_path / "j"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).select("x", "n").first()[:] == ("a", "1")
    assert spark.read.text(str(tmp_path / "j")).filter(F.col("value") != "").first()[0] == '{"x":"a","n":1,"e":null}'
    with pytest.raises(ValueError):
        ingest.export(df, str(tmp_path / "p"), "xml")


STRICT_CASES = {
    '{"product": "p1", "n": 1}': True,
    '  {"product": "p2"}  ': True,
    '{"product": null}': True,
    '{"product": "p3"} trailing': False,
    '{"product": "p4"}{"product": "p5"}': False,
    '{"product": "p6"}, {"product": "p7"}': False,
    "{'product': 'p8'}": False,
    '{"product": "p9",}': False,
    '[{"product": "p10"}]': False,
    '{"product": NaN}': True,
    "{}": False,
}


def test_only_one_strict_object_a_line(spark, tmp_path):
    write(tmp_path / "products" / "part-1.jsonl", *STRICT_CASES)
    records = jsonl.scan(jsonl.Source(spark, str(tmp_path / "products"), "products"))
    assert [not r["_rejected"] for r in records.collect()] == list(STRICT_CASES.values())


def test_an_item_without_members_is_a_row(spark, tmp_path):
    write(tmp_path / "sales_order_items" / "part-1.jsonl", {"salesOrder": "1"}, "{}")
    source = jsonl.Source(spark, str(tmp_path / "sales_order_items"), "sales_order_items")
    assert jsonl.load_stats(jsonl.scan(source), "x").first()["inserted"] == 2


def test_a_line_is_parsed_once_unless_its_keys_are_others(spark, tmp_path):
    write(
        tmp_path / "plants" / "plants.jsonl",
        {"plant": "p1", "plant Name": "a", "n": 1, "t": {"x": [1]}},
        {"plant": "p2", "plant Name": None, "n": 2, "t": "y"},
        {"plant Name": "c", "plant": "p3", "t": 1.5, "n": 3},  # in another order
        {"plant": "p4", "n": 4},  # not all of them
        '{"plant": "p5", "plant": "p6", "plant Name": "d", "n": 5, "t": null}',  # the last one counts
        '{"plant": "p7", "plant Name": "e", "n": 6, "t": null, "n": 7}',
        {"plant": "p8", "Plant-Name": "f", "n": 8, "t": None},  # known, but of another spelling
        {"plant": "p9", "plant Name": "g", "n": "many", "t": None},
        {"plant": "p10", "plant Name": "h", "n": 9, "u": None},
        '{"plant": "p11", "plant Name": "i", "n": 9, "t": null} {}',
    )
    source = jsonl.Source(spark, str(tmp_path / "plants"), "plants")
    records = jsonl.scan(source)
    assert rows_of(records.filter("not _rejected").drop("_rejected")) == sorted(
        [
            ("p1", "a", 1, '{"x":[1]}'),
            ("p2", None, 2, "y"),
            ("p3", "c", 3, "1.5"),
            ("p4", None, 4, None),
            ("p6", "d", 5, None),
            ("p7", "e", 7, None),
            ("p8", None, 8, None),
        ],
        key=repr,
    )
    assert {json.loads(line)["plant"] if "{}" not in line else "p11": reason for _, _, line, reason in jsonl.rejected_lines(source).collect()} == {
        "p9": "wrong value: n", "p10": "unknown key: u", "p11": "not one JSON object",
    }
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(ArrayType") == 1


def test_collections_are_loaded_side_by_side(spark, root, tmp_path, monkeypatch):
    # One after the other, the four tasks of a collection left the other cores idle.
    both, scan = threading.Barrier(2, timeout=60), jsonl.scan

    def scan_at_once(source):
        both.wait()
        return scan(source)

    monkeypatch.setattr(jsonl, "scan", scan_at_once)
    report = ingest.ingest(spark, str(root), str(tmp_path / "out"), ["plants", "sales_order_items"])
    assert [tuple(r) for r in report.collect()] == [("plants", 2, 0, 1), ("sales_order_items", 3, 6, 2)]
