import random

import numpy as np
import pytest

from llm_helpers import ODD_TEXTS, alnum_words

from ledgerloom.llm import decontamination
from ledgerloom.llm.decontamination import find_leaks
from ledgerloom.llm.words import ALNUM, word_hashes
from ledgerloom.llm.fm_index import FMIndex, WaveletMatrix, suffix_order


def test_wavelet_matrix():
    symbols = np.random.default_rng(1).integers(0, 11, 300)
    matrix = WaveletMatrix(symbols, 4)
    at = np.arange(301)
    for s in range(11):
        assert matrix.rank(np.full(301, s), at).tolist() == [int((symbols[:k] == s).sum()) for k in at]
    assert matrix[np.arange(300)].tolist() == symbols.tolist()


@pytest.mark.parametrize("alphabet", [2, 3, 9])
def test_fm_index_finds_all_places(alphabet):
    pick = np.random.default_rng(alphabet)
    symbols = np.append(pick.integers(0, alphabet, 400), 0)
    symbols[100:150] = 1  # a long run
    order = suffix_order(symbols, 4)
    assert sorted(order.tolist()) == list(range(401))
    patterns = np.zeros((200, 5), np.int64)
    lengths = pick.integers(1, 6, 200)
    for k, n in enumerate(lengths):
        patterns[k, :n] = pick.integers(1, alphabet, n)
    index = FMIndex(symbols, alphabet)
    which, low, high = index.search(patterns, lengths)
    found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
    for k, n in enumerate(lengths):
        places = [p for p in range(401 - n) if (symbols[p : p + n] == patterns[k, :n]).all()]
        assert found.get(k, []) == places


def by_hand(docs, benchmark, window):
    wins = {}
    for item, text in benchmark:
        w = alnum_words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, items = alnum_words(text), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    items |= wins[tuple(w[k : k + n])]
        out.append((i, len(w), sorted(hit), sorted((x for x in items if x is not None), key=str)))
    return sorted(out, key=repr)


def found(df):
    rows = []
    for r in df.select("row.doc_id", "n_words", "spans", "items").collect():
        hit = [k for s in r["spans"] for k in range(s["first"], s["after"])]
        rows.append((r["doc_id"], r["n_words"], hit, r["items"]))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("block", [500_000, 30])
def test_against_all_windows(spark, documents, prose, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    pick = random.Random(3)
    benchmark = [(k, prose(k, pick.choice((0, 1, 3, 10, 11, 25)))) for k in range(20)]
    benchmark += [(20, None), (3, prose(99, 14)), (None, prose(98, 12)), (11, benchmark[5][1])]
    docs = []
    for i in range(50):
        parts = [pick.choice(benchmark)[1] or "" if pick.random() < 0.3 else prose(500 + 9 * i + k, 20) for k in range(4)]
        docs.append((i, "\n".join(parts).title()))
    docs += [(100 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(7, docs[7][1]), (None, docs[3][1])]
    table = spark.createDataFrame(benchmark, "item_id long, text string")
    assert found(find_leaks(documents(docs, odd=True), table)) == by_hand(docs, benchmark, 10)


@pytest.mark.parametrize("shard", [11, 20, 1000])
def test_long_texts_go_to_overlapping_shards(spark, prose, monkeypatch, shard):
    monkeypatch.setattr(decontamination, "SHARD_WORDS", shard)
    items = spark.createDataFrame([(k, prose(k, 14)) for k in range(3)], "item_id long, text string")
    (block,) = decontamination._blocks(items, 10)
    texts = [f"{prose(0, 14)} {prose(7, 30)} {prose(1, 14)}", "", f"{prose(8, 55)} {prose(2, 14)} end"]
    hashes, counts = word_hashes([t.encode() for t in texts], ALNUM)
    hits = {(int(t), int(p)) for h in decontamination._hits(hashes, counts, block, 10) for t, p in zip(h[0], h[1])}
    assert hits == {(0, k) for k in range(5)} | {(0, 44 + k) for k in range(5)} | {(2, 55 + k) for k in range(5)}


def test_texts_without_the_spans(spark, documents, prose):
    item = prose(1, 15)
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = find_leaks(documents([(1, f"Before, {item.upper()}. After!"), (2, "clean text")]), table).collect()
    assert {r["row"]["doc_id"]: r["clean"] for r in rows} == {1: "Before, . After!", 2: "clean text"}


def test_blocks_are_held_one_at_a_time(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 10)
    items = [(k, prose(k, 12)) for k in range(3)]
    held = []
    send = type(spark.sparkContext).broadcast

    def watched(context, value):
        shared = send(context, value)
        assert not [h for h in held if h._path is None or h._jbroadcast.isValid()]
        held.append(shared)
        return shared

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", watched)
    docs = [(1, f"{items[0][1]} {prose(9, 20)} {items[2][1]}"), (2, prose(10, 40))] + [(3, items[1][1])] * 50
    table = spark.createDataFrame(items, "item_id long, text string")
    assert found(find_leaks(documents(docs), table)) == by_hand(docs, items, 10) and len(held) == 3


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(documents([]), none).collect() == []
    (row,) = find_leaks(documents([(1, "some text")]), none).collect()
    assert row["spans"] == [] and row["clean"] == "some text" and row["n_words"] == 2
