"""Language of each text, with spans where a text mixes languages.

The script of a word (from ranges of code points) leaves only the languages that
are written in it. Each of them scores the word by its byte trigrams; a Viterbi
path over the words, where changing the language costs a penalty, labels spans. A
word without letters, or in a script that no learned language uses, is neutral.

Trigram counts come from all documents with a language that may be learned from;
tasks count per partition and only sums are shuffled. The model has a fixed number
of numbers per language and goes to the tasks as a broadcast.

Most texts are in one language. That a path without a change is the best one is
proved for many texts at once: it is if no run of words gains more than the
penalty by leaving it. Only other texts are walked word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.frames import as_row, ready, row_and
from ledgerloom.llm.words import ALNUM, ALNUM_BLANKS, PIECE, groups, spans, texts_of

UNKNOWN = "und"
# Trigram hashes; the model has as many numbers per language.
BUCKETS = 1 << 16
# A model of so many languages takes 64 MB; more are refused.
MOST_LANGUAGES = 256
SMOOTHING = 0.1
# Log-likelihood that a change of language costs.
PENALTY = 12.0
# A language is written in a script that at least this share of its words has.
SCRIPT_SHARE = 0.02

# Code point ranges of scripts, after the Unicode blocks.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
    "syriac": ((0x700, 0x74F),),
    "thaana": ((0x780, 0x7BF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "oriya": ((0xB00, 0xB7F),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "sinhala": ((0xD80, 0xDFF),),
    "lao": ((0xE80, 0xEFF),),
    "tibetan": ((0xF00, 0xFFF),),
    "burmese": ((0x1000, 0x109F),),
    "ethiopic": ((0x1200, 0x139F),),
    "cherokee": ((0x13A0, 0x13FF),),
    "canadian": ((0x1400, 0x167F),),
    "khmer": ((0x1780, 0x17FF),),
    "mongolian": ((0x1800, 0x18AF),),
    # Letters of all other scripts; they share a bit, and only trigrams tell their languages apart.
    "other": (),
}
# Signs among letters that go with any script: modifier letters, symbols, CJK punctuation, full and half width.
NO_SCRIPT = ((0x2B0, 0x36F), (0x2000, 0x2BFF), (0x3000, 0x303F), (0xFE00, 0xFFFF))


def _script_bits() -> np.ndarray:
    """Bit of the script by the first two bytes of a character (for ASCII by the first); 0 for no letter."""
    bits = np.zeros((256, 256), np.uint32)
    listed = [(range(low, high + 1), k) for k, ranges in enumerate(SCRIPTS.values()) for low, high in ranges]
    for points, k in listed:
        for point in points:
            encoded = chr(point).encode("utf-8", "surrogatepass")
            bits[encoded[0], encoded[1] if len(encoded) > 1 else slice(None)] |= np.uint32(1 << k)
    told = np.zeros(0x20000, bool)
    for low, high in [*((p[0], p[-1]) for p, _ in listed), *NO_SCRIPT]:
        told[low : high + 1] = True
    other = np.uint32(1 << list(SCRIPTS).index("other"))
    for point in (np.flatnonzero(~told[0x250:]) + 0x250).tolist():
        if chr(point).isalpha():
            encoded = chr(point).encode()
            bits[encoded[0], encoded[1]] |= other
    for point in (0xD7, 0xF7):  # multiplication and division signs
        bits[tuple(chr(point).encode())] = 0
    return bits.ravel()


_SCRIPT_BITS = _script_bits()


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of words, ends, the trigram bucket around each byte but the first, and scripts of each word as bits."""
    data = np.frombuffer(b" " + text.translate(ALNUM_BLANKS) + b" ", np.uint8)
    starts, ends = spans(data, ALNUM)
    wide = data.astype(np.uint32)
    grams = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
    buckets = (grams * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64)
    if not len(starts):
        return starts, ends, buckets, np.zeros(0, np.uint32)
    scripts = _SCRIPT_BITS[data[:-1].astype(np.int64) << 8 | data[1:]]
    return starts, ends, buckets, np.bitwise_or.reduceat(scripts, starts)


def _inside(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int8)
    change[starts] = 1
    change[ends] = -1
    return np.cumsum(change[:-1]).astype(bool)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # log-likelihoods: language, bucket
    scripts: np.ndarray  # script bits by language
    usual: int  # the language with the most words

    def emissions(self, text: bytes) -> np.ndarray:
        """Scores (word, language), 0 throughout for neutral words, which are marked by equal scores."""
        starts, ends, buckets, scripts = _words(text)
        found = np.zeros((len(starts), len(self.languages)), np.float32)
        if not len(starts):
            return found
        edges = np.column_stack([starts, ends]).ravel()  # sums from start to end, then the gap
        for k, table in enumerate(self.scores):
            found[:, k] = np.add.reduceat(np.append(table[buckets], np.float32(0)), edges - 1)[::2]
        allowed = (scripts[:, None] & self.scripts[None, :]) != 0
        any_ = allowed.any(1)
        worst = found.min(1, keepdims=True) - np.float32(2 * PENALTY)
        found = np.where(allowed, found, worst)
        found[~any_] = 0.0
        return found


def best_paths(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word of texts with ``counts`` words; ``scores`` is (word, language)."""
    n, languages = scores.shape
    path = np.zeros(n, np.int64)
    some = np.flatnonzero(counts)
    if not len(some) or languages == 1:
        return path
    ends = np.cumsum(counts)
    begins = (ends - counts)[some]
    text = np.repeat(np.arange(len(some)), counts[some])
    whole = np.add.reduceat(scores.astype(np.float64), begins, axis=0)
    constant = whole.argmax(1)
    path[:] = constant[text]
    gain = scores.max(1).astype(np.float64) - scores[np.arange(n), path]
    other = scores.copy()
    other[np.arange(n), path] = -np.inf
    gain = np.where(gain > 0, gain, other.max(1).astype(np.float64) - scores[np.arange(n), path])
    # The largest sum of a run within each text: prefix sum minus the smallest one before it.
    prefix = np.cumsum(gain)
    reset = (np.arange(len(some)) * -(np.abs(prefix).max() * 4 + 1))[text]
    lowest = np.minimum.accumulate(np.concatenate(([0.0], prefix[:-1])) + reset)
    run = prefix + reset - lowest
    mixed = np.flatnonzero(np.maximum.reduceat(run, begins) > penalty)
    if len(mixed):
        _walk(scores, begins[mixed], counts[some][mixed], penalty, path)
    return path


def _walk(scores: np.ndarray, begins: np.ndarray, counts: np.ndarray, penalty: float, path: np.ndarray) -> None:
    """Viterbi, word by word, over all given texts side by side."""
    order = np.argsort(-counts, kind="stable")
    begins, counts = begins[order], counts[order]
    active = np.searchsorted(-counts, -np.arange(counts[0]), side="left")  # texts with more than t words
    first = np.concatenate(([0], np.cumsum(active)))
    came = np.zeros((first[-1], scores.shape[1]), np.int16)
    value = scores[begins].astype(np.float64)
    ended = np.zeros(len(counts), np.int64)
    states = np.arange(scores.shape[1])
    for t in range(1, int(counts[0])):
        k = active[t]
        if k < len(value):
            ended[k : len(value)] = value[k:].argmax(1)
            value = value[:k]
        best = value.argmax(1)
        changed = value[np.arange(k), best] - penalty
        stay = value >= changed[:, None]
        came[first[t] : first[t] + k] = np.where(stay, states, best[:, None])
        value = np.where(stay, value, changed[:, None]) + scores[begins[:k] + t]
    ended[: len(value)] = value.argmax(1)
    for t in range(int(counts[0]) - 1, -1, -1):
        k = active[t]
        path[begins[:k] + t] = ended[:k]
        if t:
            ended[:k] = came[first[t] + np.arange(k), ended[:k]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts and, under negative keys, counts of words by script, per language of a partition."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, languages = texts_of(batch.column("text")), np.array(batch.column("lang").to_pylist())
        for language in set(languages.tolist()):
            own = [texts[k] for k in np.flatnonzero(languages == language)]
            total = totals.setdefault(language, np.zeros(BUCKETS + len(SCRIPTS) + 1, np.int64))
            for i, j in groups(own, PIECE):
                data = b" ".join(own[i:j])
                starts, ends, buckets, scripts = _words(data)
                inside = _inside(starts - 1, ends - 1, len(buckets))
                total[:BUCKETS] += np.bincount(buckets[inside], minlength=BUCKETS)
                total[BUCKETS] += len(starts)
                for k in range(len(SCRIPTS)):
                    total[BUCKETS + 1 + k] += np.count_nonzero(scripts >> np.uint32(k) & np.uint32(1))
    for language, total in totals.items():
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([language] * len(keys), pa.string()), pa.array(keys), pa.array(total[keys])],
            ["lang", "key", "n"],
        )


def learn(docs: DataFrame) -> Model:
    """A model from all rows of ``docs(text, lang)`` that have a language; null texts count as empty."""
    ready(docs.sparkSession)
    known = docs.filter("lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    sums = known.mapInArrow(_counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    totals: dict[str, np.ndarray] = {}
    for row in sums.toLocalIterator():
        if row["lang"] not in totals and len(totals) == MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        totals.setdefault(row["lang"], np.zeros(BUCKETS + len(SCRIPTS) + 1))[row["key"]] = row["n"]
    languages = sorted(totals)
    scores, scripts = np.zeros((len(languages), BUCKETS), np.float32), np.zeros(len(languages), np.uint32)
    for k, language in enumerate(languages):
        grams, words, by_script = np.split(totals[language], [BUCKETS, BUCKETS + 1])
        scores[k] = np.log((grams + SMOOTHING) / (grams.sum() + SMOOTHING * BUCKETS))
        used = np.flatnonzero(by_script >= max(1.0, SCRIPT_SHARE * words[0]))
        scripts[k] = np.bitwise_or.reduce(np.left_shift(1, used)) if len(used) else 0
    usual = int(np.argmax([totals[x][BUCKETS] for x in languages])) if languages else 0
    return Model(languages, scores, scripts, usual)


def _lettered(data: bytes) -> bool:
    return any(c.isalpha() for c in data.decode()) if not data.isalpha() else True


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """The language of each row of ``docs``: ``row`` (all columns), ``lang_pred``, ``score`` and ``spans``.

    A-Z are lowered and words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. ``spans`` are
    runs of words of one language (``first`` up to but without ``after``; neutral words
    go with their neighbours). ``lang_pred`` is the language of the most words that
    aren't neutral, the first by name among equals; ``score`` is its share of them.

    A null text, or one without any letter, is ``und`` with score 0 and no spans. A
    text with letters but only neutral words gets the usual language with score 0.
    Without any learned language all are ``und``. Repeated rows get equal results, an
    empty table none; other columns pass through ``row`` and can have any name.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = as_row(docs)
    span = pa.struct([("first", pa.int64()), ("after", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        most = max(PIECE // 16, 4 * PIECE // max(4, len(model.languages)))
        for batch in batches:
            texts = texts_of(batch.column("row").field("text"))
            names, shares, runs = [], [], []
            for i, j in groups(texts, most):
                if not model.languages:
                    names += [UNKNOWN] * (j - i)
                    shares += [0.0] * (j - i)
                    runs += [[]] * (j - i)
                    continue
                scores = [model.emissions(t) for t in texts[i:j]]
                counts = np.array([len(s) for s in scores])
                scores = np.concatenate(scores)
                path = best_paths(scores, counts, penalty)
                told = scores.any(1)
                at = 0
                for text, n in zip(texts[i:j], counts.tolist(), strict=True):
                    own, sure = path[at : at + n], told[at : at + n]
                    at += n
                    votes = np.bincount(own[sure], minlength=len(model.languages))
                    if sure.any():
                        names.append(model.languages[int(votes.argmax())])
                        shares.append(float(votes.max() / votes.sum()))
                    else:
                        names.append(model.languages[model.usual] if _lettered(text) else UNKNOWN)
                        shares.append(0.0)
                    cuts = np.flatnonzero(np.diff(own, prepend=-1)).tolist() if sure.any() else []
                    ends = [*cuts[1:], n]
                    runs.append(
                        [{"first": a, "after": b, "lang": model.languages[own[a]]} for a, b in zip(cuts, ends)]
                    )
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names), pa.array(shares, pa.float64()), pa.array(runs, pa.list_(span))],
                ["row", "lang_pred", "score", "spans"],
            )

    spans_type = "array<struct<first: long, after: long, lang: string>>"
    return rows.mapInArrow(run, row_and(rows, f"lang_pred string, score double, spans {spans_type}"))


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the CRC-32 of its id as text isn't learned from; a null id is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
