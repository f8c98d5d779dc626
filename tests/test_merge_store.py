"""Batches that are merged by id, against plain dicts."""

import random

import pytest
from helpers import rows_of

from ledgerloom.operators.graph_query import merge
from ledgerloom.sources import merge_store
from ledgerloom.sources.merge_store import MergeStore

SCHEMA = "node_id string, label string"


def batch(pick):
    rows = [(f"n{pick.randrange(30)}", pick.choice(("a", "b", None))) for _ in range(12)]
    return rows + [(None, "lost")]


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_the_last_batch_wins_and_old_files_stay(spark, tmp_path):
    pick, given = random.Random(4), []
    store = MergeStore(spark, str(tmp_path / "m"), "node_id")
    for number in range(6):
        given.append(spark.createDataFrame(batch(pick), SCHEMA))
        before = files(tmp_path)
        assert store.append(given[-1]) == number
        after = files(tmp_path)
        assert {p: after[p] for p in before} == before  # a batch rewrites nothing
        known = [g.filter("node_id is not null") for g in given]
        assert rows_of(store.read(), "node_id", "label", "batch") == rows_of(merge(known, "node_id"), "node_id", "label", "batch")
        if number == 3:
            wanted = rows_of(store.read(), "node_id", "label", "batch")
            store.compact()
            assert len(store.batches()) == 1 and rows_of(store.read(), "node_id", "label", "batch") == wanted
            assert len(list((tmp_path / "m" / "batches").iterdir())) == 1
    store.compact()
    store.compact()
    assert len(store.batches()) == 1


@pytest.mark.parametrize("step", ["append", "compact"])
def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch, step):
    store = MergeStore(spark, str(tmp_path / "m"), "node_id")
    for label in "xy":
        store.append(spark.createDataFrame([("a", label), (label, label)], SCHEMA))
    wanted = rows_of(store.read())

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(merge_store, "touch", die)
        with pytest.raises(KeyboardInterrupt):
            store.compact() if step == "compact" else store.append(spark.createDataFrame([("a", "z")], SCHEMA))
    assert rows_of(store.read()) == wanted
    store.append(spark.createDataFrame([("a", "z")], SCHEMA))
    store.compact()
    assert rows_of(store.read(), "node_id", "label") == [("a", "z"), ("x", "x"), ("y", "y")]


def test_no_batches(spark, tmp_path):
    store = MergeStore(spark, str(tmp_path / "m"), "node_id")
    with pytest.raises(FileNotFoundError):
        store.read()
    store.append(spark.createDataFrame([], SCHEMA))
    assert store.read().collect() == []
