import re
from itertools import permutations

from ledgerloom.llm.filter_audit import METRICS, audit
from llm_helpers import ODD_TEXTS

SYMBOLS = set("#$%&*|")


def by_hand(rows, labels):
    """All counts, document by document."""
    found = {}
    for k, (doc_id, text, source) in enumerate(rows):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": bool(SYMBOLS & set(t)),
            "E": any((o or "") == t and j is not None and (doc_id is None or j < doc_id) for j, o, _ in rows),
        }
        marks = [(q, x) for i, q, x in labels if i == doc_id and i is not None]
        found[k] = (source or "", fails, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks))
    result, sums = {}, {}
    for part in {v[0] for v in found.values()}:
        for order in permutations("ABCDE"):
            left = [v for v in found.values() if v[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                here = [v for v in left if v[1][letter]]
                left = [v for v in left if not v[1][letter]]
                only = [v for v in left + here + gone if v[1][letter] and sum(v[1].values()) == 1]
                late = [v for v in gone if v[1][letter]]
                gone += here
                counts = len(left), len(here), len(late), len(only), sum(v[2] for v in here), sum(v[3] for v in here)
                result[part, "".join(order), step] = counts
                sums[part, letter] = sums.get((part, letter), 0) + len(here)
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in result.items()}


def run(spark, rows, labels):
    schema = "doc_id long, text string, source string, mask string, `a.b` string, `order` string, digest string"
    docs = spark.createDataFrame([(*r, "x", "y", "z", "d") for r in rows], schema)
    marks = spark.createDataFrame([(*r, "m") for r in labels], "doc_id long, quality int, toxic int, known string")
    found = audit(docs, marks).collect()
    keys = {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in (*METRICS, "shapley")) for r in found}
    assert len(keys) == len(found)
    return keys


def test_against_document_by_document(spark, prose):
    rows = [(k, t, "odd") for k, t in enumerate(ODD_TEXTS)]
    rows += [(10 + k, prose(k, 30 + 8 * k), "prose") for k in range(8)]
    rows += [(20, "word " * 80, "prose"), (21, "word " * 80, None), (22, "ABC def " * 60, ""), (23, prose(1, 60) + " $", "odd")]
    rows += [(24, prose(2, 60).title(), "prose"), (25, "A" + "a" * 19, "odd"), (26, "A" + "a" * 18, "odd")]
    rows += [(5, rows[7][1], "prose"), (5, rows[7][1], "other"), (None, rows[7][1], "other"), (None, "only here", "other")]
    rows += [(None, "only here", "other"), (40, "Word", "odd"), (41, "word", "odd"), (30, "x y z " * 40_000 + "|", "long")]
    labels = [(10, 1, 0), (11, 0, 1), (20, 1, 1), (20, 0, 0), (20, None, None), (22, 1, None), (5, 1, 0), (99, 1, 1), (None, 1, 1)]
    assert run(spark, rows, labels) == by_hand(rows, labels)


def test_copies_and_no_rows(spark):
    rows = [(k, "same text", "hot" if k % 3 else "cold") for k in range(2000)]
    found = run(spark, rows, [])
    assert len(found) == 1200 and found["cold", "ABCDE", 1][:3] == (0, 667, 0)
    assert found["cold", "EABCD", 1][:2] == (1, 666) and found["hot", "EABCD", 1][:2] == (0, 1333)
    assert found["hot", "AEBCD", 2][2] == 1333
    assert run(spark, [], [(1, 1, 1)]) == {}
