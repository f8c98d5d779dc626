import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.fingerprints import MinHash, edited_neighbours, fingerprints, likeness
from llm_helpers import ODD_TEXTS, words


def shingles(text):
    w = words(text)
    size = min(5, len(w))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("minhash", [MinHash(), MinHash(bins=512, bits=16), MinHash(bins=1024, bits=8)])
def test_estimates_are_unbiased_and_close(prose, minhash):
    errors = []
    for k in range(80):
        text = prose(k, 30 + 10 * k)
        cut = len(text) * (k % 10) // 10
        other = text[:cut] + prose(1000 + k, 40)
        own, edited = minhash.fingerprints([text.encode(), other.encode()])
        errors.append(minhash.likeness(own[None], edited[None])[0] - jaccard(text, other))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.2 * (0.25 / minhash.bins) ** 0.5


def test_few_shingles_fill_all_bins(prose):
    minhash = MinHash()
    one, same, other, none = minhash.fingerprints([b"one", b" one ", b"two", b"  "])
    assert (one == same).all() and (none == 0).all()
    assert minhash.likeness(one[None], other[None])[0] < 0.1
    assert len(np.unique(one)) == 1  # one value in every bin


def test_neighbours_against_plain_code(documents, prose):
    rows = [(3 * i, prose(i, 5 + 7 * i)) for i in range(25)] + [(200 + k, t) for k, t in enumerate(ODD_TEXTS)]
    rows += [(301, "é" * 41 + " ü ö"), (302, prose(3, 16)), (303, prose(3, 16))]
    ordered = sorted(rows)
    expected = {}
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        quarter = len(text) // 4
        expected[i] = (len(text), text[: len(text) - quarter] + after[:quarter], text, after)
    for ranges in (1, 4, 50):
        found = edited_neighbours(documents(rows, odd=True), ranges=ranges).collect()
        assert len(found) == len(rows)
        for r in found:
            n, edited, text, after = expected[r["doc_id"]]
            assert (r["n_chars"], r["edited"]) == (n, edited)
            assert abs(r["near_next"] - jaccard(text, after)) < 0.15 and abs(r["near_edited"] - jaccard(text, edited)) < 0.15


def test_repeated_and_null_ids(documents):
    rows = [(1, "one a"), (1, "one a"), (1, "one b"), (None, "last"), (None, "last")]
    found = edited_neighbours(documents(rows), ranges=3).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "1", "1", "None", "None"]
    (alone,) = edited_neighbours(documents([(5, "abcdefgh")])).collect()
    assert alone["edited"] == "abcdefab" and alone["near_next"] == 1.0
    assert edited_neighbours(documents([])).collect() == []


def test_columns_alone(documents, prose):
    docs = documents([(1, prose(1, 90)), (2, prose(1, 90)), (3, prose(2, 90)), (4, None), (5, "")], odd=True)
    prints = fingerprints(docs)
    rows = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    assert rows[1] == rows[2] != rows[3] and rows[4] == rows[5] == "0" * 512
    pairs = prints.alias("a").join(prints.alias("b"), F.expr("a.doc_id < b.doc_id"))
    near = pairs.select("a.doc_id", "b.doc_id", likeness(F.col("a.fingerprint"), F.col("b.fingerprint"))).collect()
    close = {(r[0], r[1]): r[2] for r in near}
    assert close[1, 2] == close[4, 5] == 1.0 and close[1, 3] < 0.1
    assert fingerprints(documents([])).collect() == []
