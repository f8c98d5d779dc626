import numpy as np
import pytest

from ledgerloom.llm import words as W


@pytest.mark.parametrize("piece", [16, 1 << 20])
def test_word_hashes_tell_words_apart_whatever_the_piece(monkeypatch, piece):
    monkeypatch.setattr(W, "PIECE", piece)
    texts = [b"one two  three", b"", b"\ttwo\none\x00 one", b"a-very-long-word-of-more-than-a-piece and two", "é two".encode()]
    hashes, counts = W.word_hashes(texts, W.SPACED)
    flat = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_alnum_words_are_lowered_and_split_at_ascii_separators():
    one, _ = W.word_hashes([b"Ab-c1 \xc3\xa9_x".translate(W.ALNUM_BLANKS)], W.ALNUM)
    other, _ = W.word_hashes([b"ab", b"c1", b"\xc3\xa9", b"x"], W.ALNUM)
    assert one.tolist() == other.tolist()


def test_windows_hash_by_content_alone():
    hashes, _ = W.word_hashes([b"a b c d a b c e"], W.SPACED)
    found = W.Windows(hashes).hash(np.arange(6), 3)
    assert found[0] == found[4] and len(set(found.tolist())) == 5


@pytest.mark.parametrize("width", [1, 2, 5, 8, 13])
def test_sliding_minimum(width):
    values = np.random.default_rng(1).integers(0, 50, 40)
    expected = [values[k : k + width].min() for k in range(40 - width + 1)]
    assert W.sliding(values, width, np.minimum).tolist() == expected


def test_covered():
    assert W.covered(np.array([1, 2, 6]), 2, 7).tolist() == [False, True, True, True, False, False, True]
