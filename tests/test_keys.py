import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.functions.metadata import parse_metadata, to_metadata
from ledgerloom.functions.typed import amount, day, iso_timestamp, timestamp

TEXTS = [None, "", " ", "0", "10", "000010", "1234567", " 20 ", "A1", "+5", "-5", "1.5", " 7 ", "12345678901"]


def values(spark, expression, texts=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [row[0] for row in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_item6_pads_and_cuts(spark):
    expected = [None if t is None else (t[:6] if len(t) >= 6 else t.rjust(6, "0")) for t in TEXTS]
    assert values(spark, keys.item6) == expected


def test_trace_item_pads_like_text_and_spells_missing(spark):
    assert values(spark, keys.trace_item) == [str(t).zfill(6) for t in TEXTS]


@pytest.mark.parametrize("expression,width,missing", [(keys.loaded_item, 6, ""), (keys.coverage_key, 10, "None")])
def test_digit_padding(spark, expression, width, missing):
    stripped = [missing if t is None else t.strip() for t in TEXTS]
    assert values(spark, expression) == [t.zfill(width) if t.isdigit() else t for t in stripped]


def test_loaded_item_key(spark):
    df = spark.createDataFrame([("d", "10"), (None, "10"), ("d", None)], "d string, i string")
    got = [r[0] for r in df.select(keys.loaded_item_key(F.col("d"), F.col("i"))).collect()]
    assert got == ["d_000010", "_000010", "d_"]


def test_present(spark):
    assert values(spark, keys.present, [None, "", "x"]) in ([None, False, True], [False, False, True])


def test_metadata_keeps_null_members(spark):
    df = spark.range(1).select(to_metadata({"a": F.lit(None).cast("string"), "b": F.lit("x"), "c": F.lit(True)}))
    assert df.first()[0] == '{"a":null,"b":"x","c":true}'


def test_parse_metadata(spark):
    got = values(spark, parse_metadata, [None, '{"a":"x","b":null}', "not json", "[1]", '{"n":{"k":1}}'])
    assert got == [{}, {"a": "x", "b": None}, {"raw": "not json"}, {"raw": "[1]"}, {"n": '{"k":1}'}]


def test_typed_values(spark):
    assert [None if v is None else str(v) for v in values(spark, amount, ["17108.25", "9966.1", "x", None])] == [
        "17108.25", "9966.10", None, None,
    ]
    assert [None if v is None else str(v) for v in values(spark, day, ["2025-03-31T00:00:00.000Z", "", "bad", None])] == [
        "2025-03-31", None, None, None,
    ]
    df = spark.createDataFrame(
        [("2025-03-31T00:00:00.000Z", '{"hours":6,"minutes":49,"seconds":13}'), ("2025-03-31", None)], "d string, c string"
    )
    first, second = df.select(
        iso_timestamp(F.col("d"), F.col("c")), timestamp(F.col("d"), F.col("c")).cast("string")
    ).collect()
    assert tuple(first) == ("2025-03-31T06:49:13.000Z", "2025-03-31 06:49:13")
    assert tuple(second) == (None, None)
