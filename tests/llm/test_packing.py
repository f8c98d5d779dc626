import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from ledgerloom.llm.packing import Packing, WordIds, pack
from llm_helpers import ODD_TEXTS

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_ids_are_those_of_the_whole_text(monkeypatch, prose):
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    texts = [t or "" for t in ODD_TEXTS] + [
        "It's DON'T we'll a's 'd 12³ ½ x2y",
        "Ünïcode naïve ÇA İstanbul ΑΣ σς Привет 你好 é  nbsp em\x1cfs\x85nel",
        "<|endoftext|> a<|startoftext|>b \x00\x01 ﬁ Ⅷ 👩‍👩‍👧",
        "*** &&&word%%% _under_ don’t",
        prose(1, 300),
        prose(1, 300).title(),
    ]
    whole, own = Tokenizer.from_file(PATH), WordIds(PATH)
    for text in texts * 2:
        assert own(text.encode()).tolist() == whole.encode(text, add_special_tokens=False).ids


def cost(ends, stops, sentences, p):
    total, begin = 0.0, 0
    for e in ends:
        size = e - begin
        total += p.sequence + (0 if size & (size - 1) == 0 else p.size - size)
        total += 0 if e in stops else p.sentence_cut if e in sentences else p.word_cut
        begin = e
    return total


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_best_of_all(seed):
    pick = random.Random(seed)
    p = Packing(size=16, sentence_cut=2, word_cut=5, sequence=1)
    n = pick.randint(1, 60)
    stops = sorted({*pick.sample(range(1, n + 1), min(n, pick.randint(1, 4))), n})
    sentences = sorted(set(pick.sample(range(1, n + 1), min(n, pick.randint(0, 6)))))
    places, _ = p._places(np.array(stops), np.array(sentences, np.int64), n)
    found = p.ends(np.array(stops), np.array(sentences, np.int64), n, last=True)
    inner = [x for x in places.tolist() if 0 < x < n]
    best = min(
        cost([*c, n], stops, sentences, p)
        for k in range(len(inner) + 1)
        for c in itertools.combinations(inner, k)
        if all(b - a <= p.size for a, b in zip((0, *c), (*c, n)))
    )
    assert found[-1] == n and cost(found, stops, sentences, p) == pytest.approx(best)


def check(rows, pieces, size):
    whole = Tokenizer.from_file(PATH)
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for (i, _), own in zip(rows, ids):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(own[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(own)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / sum(map(len, ids))


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_pieces_hold_all_ids_once(spark, documents, prose, block):
    pick = random.Random(block)
    rows = [(i, ". ".join(prose(i * 9 + k, pick.randint(1, 12)) for k in range(pick.randint(1, 9)))) for i in range(40)]
    rows += [(100 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(200, prose(1, 900))]
    old, packing.BLOCK_TOKENS = packing.BLOCK_TOKENS, block
    try:
        pieces = pack(documents(rows, odd=True), PATH, Packing(size=128)).collect()
    finally:
        packing.BLOCK_TOKENS = old
    assert check(rows, pieces, 128) < 0.1


def test_blocks_join_without_loss(prose):
    """A task that packs in small blocks, without Spark."""
    p = Packing(size=64)
    packer = packing._Packer(p, np.zeros(49408, bool), 0)
    rows, pieces = [(i, prose(i, 37)) for i in range(30)] + [(99, prose(7, 400))], []
    encode = WordIds(PATH)
    for i, text in rows:
        packer.add(i, np.append(encode(text.encode()), np.uint32(2)))
        while packer.waiting >= 200:
            pieces += packer.flush(last=False).to_pylist()
    pieces += packer.flush(last=True).to_pylist()
    check(rows, pieces, 64)


def test_repeated_rows_null_ids_and_no_rows(documents):
    pieces = pack(documents([(1, "a b"), (1, "a b"), (None, "c")]), PATH).collect()
    assert {(str(r["doc_id"]), r["doc_tokens"]) for r in pieces} == {("1", 3), ("None", 2)}
    assert sum(r["length"] for r in pieces) == 8
    assert pack(documents([]), PATH).collect() == []
