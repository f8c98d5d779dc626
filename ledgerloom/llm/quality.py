"""Quality scores by positive-unlabelled learning.

Trusted positives are documents labelled 1, the unlabelled set is a sample of all
documents, and the class prior is the share of 1 among labelled documents. A small
network over statistics of a text minimises the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the logistic loss; where the second part falls below zero its gradient is
reversed, which keeps the network from fitting positives as negatives.

The fit uses at most ``SAMPLE`` documents of either set, drawn by a hash of the
id; counts and scores cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import as_row, ready, row_and
from ledgerloom.llm.words import SPACED, Windows, spans, texts_of, word_hashes

# Most documents in either training set; the sets go to the driver as statistics only.
SAMPLE = 20_000
HIDDEN = 24
STEPS = 1500
BATCH = 1024
LEARNING_RATE = 0.01
THRESHOLD = 0.3

# Byte classes whose shares are statistics.
_CLASSES = {
    "lower": range(0x61, 0x7B),
    "upper": range(0x41, 0x5B),
    "digit": range(0x30, 0x3A),
    "blank": (0x20, 0x09),
    "line": (0x0A, 0x0D),
    "stop": b".!?",
    "pause": b",;:'\"()-",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "wide": range(0x80, 0x100),
}
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _k, _bytes in enumerate(_CLASSES.values()):
    _CLASS[list(_bytes)] = _k
_UPPER, _SYMBOL = list(_CLASSES).index("upper"), list(_CLASSES).index("symbol")
STATISTICS = len(_CLASSES) + 14


def statistics(data: bytes) -> np.ndarray:
    """Numbers that tell prose from junk, none of which grows with the length except its logarithm."""
    found = np.zeros(STATISTICS)
    view = np.frombuffer(data, np.uint8)
    if not len(view):
        return found
    kinds = _CLASS[view]
    found[: len(_CLASSES)] = np.bincount(kinds, minlength=len(_CLASSES) + 1)[: len(_CLASSES)] / len(view)
    rest = found[len(_CLASSES) :]
    starts, ends = spans(view, SPACED)
    n = len(starts)
    if not n:
        return found
    hashes, _ = word_hashes([data], SPACED)
    _, counts = np.unique(hashes, return_counts=True)
    sizes = ends - starts
    first, last = kinds[starts], kinds[ends - 1]
    shouted = (first == _UPPER) & (kinds[np.minimum(starts + 1, ends - 1)] == _UPPER) & (sizes > 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    rest[0] = np.log1p(n) / 10
    rest[1] = sizes.mean() / 20
    rest[2] = min(sizes.std() / 20, 5.0)
    rest[3] = len(counts) / n
    rest[4] = counts.max() / n
    rest[5] = np.log(len(counts)) / np.log(n) if n > 1 else 1.0
    rest[6] = np.mean(hashes[1:] == hashes[:-1]) if n > 1 else 0.0
    rest[7] = np.mean(last == _SYMBOL)
    rest[8] = np.mean((first == _SYMBOL) & (sizes == 1))
    rest[9] = shouted.mean()
    rest[10] = 1 - len(set(lines)) / len(lines)
    rest[11] = np.mean((view[ends - 1] == 0x21) | (view[ends - 1] == 0x3F))
    rest[12] = min(len(lines) / n, 1.0)
    if n >= 4:
        runs = Windows(hashes).hash(np.arange(n - 3), 4)
        rest[13] = 1 - len(np.unique(runs)) / len(runs)
    return found


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        inner, bias, outer, shift = self.weights
        return np.tanh((x - self.mean) / self.scale @ inner + bias) @ outer + shift[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> Network:
    """Minimise the non-negative unbiased risk by Adam over mini-batches."""
    pick = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    positive, unlabelled = (positive - mean) / scale, (unlabelled - mean) / scale
    size = positive.shape[1]
    weights = [pick.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    weights[2] = pick.normal(0, HIDDEN**-0.5, HIDDEN)
    moment, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        p = positive[pick.integers(0, len(positive), BATCH)]
        u = unlabelled[pick.integers(0, len(unlabelled), BATCH)]
        x = np.concatenate([p, u])
        hidden = np.tanh(x @ weights[0] + weights[1])
        z = hidden @ weights[2] + weights[3][0]
        zp, zu = z[:BATCH], z[BATCH:]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        d = np.empty(2 * BATCH)
        if negative >= 0:
            d[:BATCH] = prior * (_sigmoid(zp) - 1) - prior * _sigmoid(zp)
            d[BATCH:] = _sigmoid(zu)
        else:
            d[:BATCH] = prior * _sigmoid(zp)
            d[BATCH:] = -_sigmoid(zu)
        d /= BATCH
        back = np.outer(d, weights[2]) * (1 - hidden**2)
        gradient = [x.T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ d + 1e-4 * weights[2], np.array([d.sum()])]
        for k, g in enumerate(gradient):
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            ahead = moment[k] / (1 - 0.9**step)
            weights[k] = weights[k] - LEARNING_RATE * ahead / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, weights)


def _table(docs: DataFrame) -> np.ndarray:
    """Statistics of a bounded table of texts, at the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.float64()))], ["d", "x"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "d long, x array<double>").collect()
    return np.array([r["x"] for r in sorted(rows)]).reshape(-1, STATISTICS)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Network | None:
    """A network from the rows of ``docs(doc_id, text)`` and ``labels(doc_id, quality)`` that may be learned from.

    At most about ``sample`` positives and as many unlabelled documents are used,
    chosen by a hash of ``doc_id``. Without a positive label nothing can be learned.
    The class prior is the share of 1 among the labelled documents, which is that of
    the unlabelled ones only if labels are drawn evenly from them.
    """
    ready(docs.sparkSession)
    marks = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null")
    told = marks.agg(F.count("*").alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("good")).first()
    if not told["good"]:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))

    def some(ids: DataFrame, n: int) -> DataFrame:
        # The share leaves room for chance; ``limit`` only holds the bound itself.
        share = min(1.0, 0.95 * sample / max(n, 1))
        return ids.filter(place < int(share * (1 << 20)) + 1).select("doc_id").distinct().limit(sample)

    known = docs.filter("doc_id is not null")
    good = some(marks.filter("quality = 1"), told["good"])
    web = some(known.select("doc_id"), known.count())
    # Both id tables are bounded by ``sample``, so they can be sent to the texts.
    positive = _table(known.join(F.broadcast(good), "doc_id", "left_semi"))
    unlabelled = _table(known.join(F.broadcast(web), "doc_id", "left_semi"))
    if not len(positive):
        return None
    return fit(positive, unlabelled, float(np.clip(told["good"] / told["n"], 0.01, 0.99)), seed)


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score`` (0 to 1, higher: label 1 likelier) of each row; whole texts.

    A null text counts as empty; an empty text has all statistics 0 and a score like
    any other. Without a network all scores are 0.5. Repeated rows get equal scores,
    an empty table none; other columns pass through ``row`` and can have any name.
    Nothing is shuffled.
    """
    ready(docs.sparkSession)
    rows = as_row(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("row").field("text"))
            if network is None:
                scores = np.full(len(texts), 0.5)
            else:
                scores = network.score(np.array([statistics(t) for t in texts]).reshape(-1, STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores)], ["row", "score"])

    return rows.mapInArrow(run, row_and(rows, "score double"))
