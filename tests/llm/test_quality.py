import os
import zlib

import numpy as np
import pytest

from ledgerloom.llm import quality
from llm_helpers import ODD_TEXTS

FOLDER = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")


def test_the_risk_finds_positives_among_unlabelled():
    pick = np.random.default_rng(3)
    good, bad = pick.normal(1.5, 1, (3000, 4)), pick.normal(-1.5, 1, (3000, 4))
    unlabelled = np.concatenate([good[:1400], bad[:600]])
    network = quality.fit(good[2000:], unlabelled, 0.7)
    assert (network.score(good[1400:2000]) > 0.5).mean() > 0.95
    assert (network.score(bad[600:]) < 0.5).mean() > 0.95


def test_statistics_are_finite_for_all_texts():
    for text in [*ODD_TEXTS, "a", "a a", "A\n\nA", "x" * 5000, "\x00", "| | |"]:
        found = quality.statistics((text or "").encode())
        assert found.shape == (quality.STATISTICS,) and np.isfinite(found).all() and np.abs(found).max() < 300


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
def test_held_out_accuracy(spark):
    from ledgerloom.llm.queries import QUERIES

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op2_quality_classifier"](spark, FOLDER).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    judged = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in judged]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_odd_rows(spark, documents, prose):
    rows = [(k, prose(k, 50)) for k in range(20)] + [(50 + k, "!! " * 40) for k in range(6)]
    rows += [(90 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(3, "x y"), (None, "z")]
    docs = documents(rows, odd=True)
    marks = [(k, 1) for k in range(20)] + [(50 + k, 0) for k in range(6)] + [(None, 1), (7, None), (999, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    network = quality.learn(docs, labels)
    scores = quality.score(docs, network).collect()
    assert len(scores) == len(rows) and all(0 <= r["score"] <= 1 for r in scores)
    assert quality.score(documents([]), network).collect() == []
    assert quality.learn(docs, labels.filter("quality = 0")) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {0.5}
