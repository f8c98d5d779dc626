"""Words of whole texts as numpy arrays, in bounded pieces.

Texts are UTF-8 bytes. Which bytes are part of a word is a table of 256 flags,
so a class of ASCII separators never splits a character. Word hashes are 64-bit
and the same in every task and session.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# Bytes that are hashed at once: temporary arrays take about 40 times as much.
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _flags(separators: Iterable[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


# [^\x20\x09-\x0D]+
SPACED = _flags([0x20, *range(0x09, 0x0E)])
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after A-Z became lower case
ALNUM = _flags([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
# For ALNUM words of a text as it is: lowers A-Z and turns every separator into a blank.
ALNUM_BLANKS = bytes(LOWER[b] if ALNUM[LOWER[b]] else 0x20 for b in range(256))


class _Powers:
    """Powers of the hash base and of its inverse, made once and extended when needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE, np.uint64)])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    inside = table[data].view(np.int8)
    edges = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair: a polynomial that doesn't depend on the place."""
    up, down = _powers.upto(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def pieces(data: bytes, table: np.ndarray) -> Iterator[bytes]:
    """``data`` in pieces of about PIECE bytes, cut where no word is; a longer word stays whole."""
    view, at = np.frombuffer(data, np.uint8), 0
    while len(data) - at > PIECE:
        size = PIECE
        while True:
            gaps = np.flatnonzero(~table[view[at : at + size]])
            if len(gaps) or at + size >= len(data):
                break
            size *= 2
        cut = at + (int(gaps[-1]) + 1 if len(gaps) else len(data) - at)
        yield data[at:cut]
        at = cut
    yield data[at:]


def _hash_piece(data: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    view = np.frombuffer(data, np.uint8)
    starts, ends = spans(view, table)
    return _range_hash(view.astype(np.uint64) + np.uint64(1), starts, ends), starts


def word_hashes(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words of each text."""
    found: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < PIECE):
            size += len(texts[j]) + 1
            j += 1
        if j == i + 1:
            for piece in pieces(texts[i], table):
                hashes, _ = _hash_piece(piece, table)
                found.append(hashes)
                counts[i] += len(hashes)
        else:
            hashes, starts = _hash_piece(b" ".join(texts[i:j]), table)
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
            upto = np.searchsorted(starts, ends)
            counts[i:j] = np.diff(upto, prepend=0)
            found.append(hashes)
        i = j
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


class Windows:
    """Hashes of runs of consecutive words, for any length."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = _powers.upto(len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[:-1], out=self.total[1:])

    def hash(self, starts: np.ndarray, length: int) -> np.ndarray:
        """``starts + length`` must lie within the words."""
        return mix((self.total[starts + length] - self.total[starts]) * self.down[starts] + np.uint64(length))

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of each ``width`` neighbours; len(values) - width + 1 results."""
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Flags of the ``n`` words that lie in a run of ``length`` words from one of ``starts``."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n), -1)
    return np.cumsum(change[:-1]) > 0


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def groups(texts: list[bytes], most: int = 4 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about ``most`` bytes; a longer text is alone."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= most:
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def signed(hashes: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return hashes.view(np.int64)
