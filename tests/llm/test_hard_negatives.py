import re
import tracemalloc

import numpy as np
import pytest

from ledgerloom.llm import hard_negatives
from ledgerloom.llm.hard_negatives import mine

SCHEMA = "vec_id long, label int, vector array<long>, anchor boolean, id string, leaf string, `a.b` string"


def by_hand(rows, positives=5, negatives=10, window=(30, 90)):
    d = max((len(v) for _, _, v, _ in rows if v), default=0)
    seen = {}
    for i, label, v, anchor in sorted(
        (r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]),
        key=lambda r: (r[0], not r[3], r[1], r[2]),
    ):
        seen.setdefault(i, (label, v + [0] * (d - len(v)), anchor))
    result = set()
    for a, (label, x, anchor) in seen.items():
        if not anchor:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, other) for i, (other, y, _) in seen.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            fit = [r for r in scored if r[2] != label and window[0] * -s <= 100 * -r[0] <= window[1] * -s]
            result |= {(a, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit[:negatives], 1)}
    return result


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "i", "l", "z") for r in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in mine(df, **more).collect()]
    assert len(found) == len(set(found))
    return set(found)


def made(pick, n, d, scale=90):
    middles = pick.normal(size=(6, d))
    x = np.floor(scale * (middles[pick.integers(0, 6, n)] + pick.normal(size=(n, d)))).astype(int)
    return [(k, int(pick.integers(0, 4)), x[k].tolist(), k % 20 == 0) for k in range(n)]


def test_against_all_scores(spark, monkeypatch):
    pick = np.random.default_rng(1)
    rows = made(pick, 900, 6)
    # A hot group of equal vectors under two labels, and coarse vectors with many ties.
    rows += [(2000 + k, k % 2, [50, -20, 30, 0, 10, 0], k < 3) for k in range(400)]
    rows += [(3000 + k, k % 3, [int(c) for c in pick.integers(-1, 2, 6)], k < 3) for k in range(150)]
    monkeypatch.setattr(hard_negatives, "LEAF", 4)
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 8)
    assert run(spark, rows) == by_hand(rows)


def test_visits_are_not_sent_to_the_driver(spark, monkeypatch):
    # Taken for as few as the anchors, all visits of the anchors were broadcast.
    pick = np.random.default_rng(3)
    rows = made(pick, 900, 6)
    plans, first_ones = [], hard_negatives._first_ones

    def seen(found, most):
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return first_ones(found, most)

    monkeypatch.setattr(hard_negatives, "_first_ones", seen)
    monkeypatch.setattr(hard_negatives, "LEAF", 4)
    monkeypatch.setattr(hard_negatives, "BUCKETS", 4, raising=False)
    assert run(spark, rows) == by_hand(rows)
    assert len(plans) == 4 and not any(re.search(r"BroadcastHashJoin \[(leaf|bucket)#", plan) for plan in plans)


def test_a_tree_grows_in_little_memory():
    # All differences between the sample and the split points at once took 270 MB of the driver.
    sample = np.random.default_rng(4).normal(size=(hard_negatives.SAMPLE, 65))
    tracemalloc.start()
    hard_negatives._grow(sample, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6


def test_subtrees_are_eliminated(spark):
    pick = np.random.default_rng(2)
    x = pick.normal(size=(3000, 3))
    x = np.floor(1000 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(int)
    schema = "id long, label long, vector array<long>, anchor boolean"
    rows = spark.createDataFrame([(k, 0, v.tolist(), k < 50) for k, v in enumerate(x)], schema)
    space = hard_negatives._space(rows)
    placed, tree = hard_negatives._planted(hard_negatives._stored(rows, space), space)
    q = np.c_[x[:50], np.zeros(50)]
    least, most, _ = tree.bounds(q)
    leaf = np.array([r["leaf"] for r in placed.orderBy("id").collect()])
    rest = np.sqrt(np.maximum(space.square - (x * x).sum(1), 0))
    d = np.linalg.norm(q[:, None] - np.c_[x, rest], axis=2)
    assert (least[:, leaf] <= d + space.slack).all() and (most[:, leaf] >= d - space.slack).all()
    ends = np.sort(d, axis=1)[:, 10:11]
    assert ((least <= ends) & np.isfinite(least)).mean() < 0.6


def test_odd_rows(spark):
    rows = [(1, 0, [3, 4], True), (2, 0, [5], False), (2, 0, [1, 1], False), (3, 1, [2, 1], False), (4, 1, [], False)]
    rows += [(5, 1, None, True), (6, None, [1, 1], True), (None, 1, [1, 1], True), (7, 1, [1, None], False)]
    rows += [(8, 0, [-9, -9], False), (9, 1, [0, 2], None), (10, 2, [1, 0], False), (3, 1, [2, 1], False)]
    assert run(spark, rows) == by_hand(rows) and run(spark, rows, positives=1, negatives=1) == by_hand(rows, 1, 1)
    assert run(spark, []) == set() and run(spark, [(1, 0, [1], False)]) == set() and run(spark, [(1, 0, [1], True)]) == set()


def test_large_numbers(spark):
    pick = np.random.default_rng(4)
    rows = [(k, k % 3, [int(c) for c in pick.integers(-(1 << 26), 1 << 26, 4)], k % 10 == 0) for k in range(200)]
    assert run(spark, rows) == by_hand(rows)
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(1, 0, [1 << 40], True)])
