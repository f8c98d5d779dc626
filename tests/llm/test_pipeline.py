"""The pipeline against plain code, stage by stage."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from llm_helpers import alnum_words, words
from tokenizers import Tokenizer

from ledgerloom.llm.simhash_dedup import fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def lettered(rows):
    return {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}


def without_near_copies(rows):
    lowered = {i: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()) for i, t in rows.items()}
    prints = {i: fingerprint(t.split()) for i, t in lowered.items()}
    group = {i: i for i in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    return {i: t for i, t in rows.items() if group[i] == i}


def cut(text, spans):
    """``text`` without the byte ranges."""
    data, at, kept = text.encode(), 0, []
    for first, after in spans:
        kept.append(data[at:first])
        at = after
    return b"".join([*kept, data[at:]]).decode()


def runs(flags):
    edges = np.flatnonzero(np.diff([0, *flags, 0]))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def places(text, own):
    """Byte offsets where the words ``own`` of ``text`` start."""
    data, at, found = text.encode().lower(), 0, []
    for w in own:
        at = data.index(w.lower(), at)
        found.append(at)
        at += len(w)
    return found


def without_repeats(rows):
    first, out = {}, {}
    for i in sorted(rows):
        w = words(rows[i])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, text in rows.items():
        w = words(text)
        gone = [0] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [1] * 50
        if not gone or not all(gone):
            starts = [*places(text, w), len(text.encode())]
            out[i] = cut(text, [(starts[a], starts[b]) for a, b in runs(gone)])
    return out


def without_benchmark(rows, items):
    windows = {tuple(w[k : k + 10]) for w in map(alnum_words, items) for k in range(len(w) - 9)}
    out = {}
    for i, text in rows.items():
        w = alnum_words(text)
        hit = [0] * len(w)
        for k in range(len(w) - 9):
            if tuple(w[k : k + 10]) in windows:
                hit[k : k + 10] = [1] * 10
        if not w or not all(hit):
            starts = places(text, w)
            out[i] = cut(text, [(starts[a], starts[b - 1] + len(w[b - 1])) for a, b in runs(hit)])
    return out


@pytest.fixture(scope="module")
def folder(spark, vocabulary, tmp_path_factory):
    pick = np.random.default_rng(8)

    def prose(n):
        return " ".join(pick.choice(vocabulary, n))

    items, passage = [prose(20) for _ in range(3)], prose(60)
    texts = [f"{prose(30)}.\n{prose(40)}." for _ in range(25)]
    texts += [texts[3], texts[3].upper(), f"{texts[4]} {passage}", f"{prose(20)}\n{passage}\n{prose(9)}", passage]
    texts += [f"{prose(15)} {items[0].title()} {prose(12)}", items[1], None, "", "123 ... 456", f"{prose(80)}. " * 2]
    rows = [(k, t, "xx", "s", len(t or "")) for k, t in enumerate(texts)]
    out = str(tmp_path_factory.mktemp("pipeline"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, dict(enumerate(texts)), items


def test_stages(spark, folder):
    path, expected, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    plain = [lettered, without_near_copies, without_repeats, lambda rows: without_benchmark(rows, items)]
    for (name, function), stage in zip(corpus_pipeline.STAGES, plain):
        before = len(expected)
        docs, expected = corpus_pipeline.stage(function(spark, docs, path), "test"), stage(expected)
        assert docs.columns == COLUMNS, name
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == expected, name
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        assert len(expected) < before
    pieces = corpus_pipeline.run(spark, path).collect()
    tokenizer, found = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), defaultdict(list)
    for r in pieces:
        found[r["doc_id"]].append(r)
    assert set(found) == set(expected)
    for i, text in expected.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        for r in found[i]:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert sum(r["length"] for r in found[i]) == len(ids)


def test_no_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder[0]}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
