"""Pack documents into training sequences by order-preserving dynamic programming.

Tokens of all documents of a task form one stream, in order. Sequences are windows
of that stream; a cut between two of them lies at the end of a document (free) or
of a sentence (a penalty), and where none is near, inside a sentence (a larger
penalty). The cuts with the least padding plus penalties are found by dynamic
programming: the cost of a window is its padding, so the best start for an end is
the minimum of (cost so far + place) over starts at most a window back, which a
monotone queue holds. Windows whose size is a power of two need no padding and
are tried on their own.

The stream is cut in blocks of bounded size; what the last window of a block would
pad goes on with the next block. Nothing is shuffled.
"""

from __future__ import annotations

import re
import string
import struct
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.frames import ready
from ledgerloom.llm.words import SPACED, pieces, texts_of

END = 2  # the id behind each document
SIZE = 4096
# Padding tokens that a cut inside a document is worth.
SENTENCE_CUT = 8
WORD_CUT = 64
# Padding tokens that one more sequence is worth.
SEQUENCE = 4
# Tokens packed at once; they take about 30 bytes each.
BLOCK_TOKENS = 1_000_000
# Words and pieces whose ids a worker remembers, in two generations of about 200 bytes an entry.
REMEMBERED = 500_000
_PUNCTUATION = string.punctuation.encode()
# What all special tokens hold.
_SPECIAL = "<|"


def _letters_of(categories: str) -> str:
    """The characters below U+0250 whose category starts with one of ``categories``, for a class of a pattern."""
    return "".join(map(re.escape, (chr(x) for x in range(0x250) if unicodedata.category(chr(x))[0] in categories)))


class WordIds:
    """Ids of texts by a tokenizer whose words are independent of each other.

    White space is dropped and separates, so the ids of a text are those of its
    words one after the other, and a word is encoded once while it is remembered.
    Words of plain characters are split as the tokenizer's own pattern does, and
    their pieces, words themselves, reach its model directly; all others go through the
    whole tokenizer. Capitals don't matter, so A-Z are lowered first.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        letters, digits = _letters_of("L"), _letters_of("N")
        # Below U+0250 lower case needs no context and the normal form changes nothing.
        plain = "".join(map(re.escape, (chr(x) for x in range(0x250) if chr(x).isprintable())))
        self.odd = re.compile(f"[^{plain}]")
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+")
        # The model spells a byte as the character of its number, or where that can't be printed as the next one from 256.
        printed = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.spelling = {x: 256 + k for k, x in enumerate(x for x in range(256) if x not in printed)}
        if not all(_SPECIAL in t.content for t in self.whole.get_added_tokens_decoder().values()):
            raise ValueError("this tokenizer has special tokens of another form")
        self.young, self.old = {}, {}

    def _one(self, word: bytes) -> bytes:
        """Ids of a word in which A-Z are lower case."""
        ids = self.young.get(word)
        if ids is None:
            ids = self.old.get(word)
            self.young[word] = ids = self._encoded(word) if ids is None else ids
        return ids

    def _encoded(self, word: bytes) -> bytes:
        core = word.rstrip(_PUNCTUATION)
        if core.isalpha() or not core:
            if core and len(core) < len(word):
                return self._one(core) + self._one(word[len(core) :])
            return self._piece(word)
        text = word.decode().lower()
        if self.odd.search(text):
            return self._whole(word)
        found = self.split.findall(text)
        return self._piece(found[0].encode()) if len(found) == 1 else b"".join(self._one(x.encode()) for x in found)

    def _piece(self, piece: bytes) -> bytes:
        spelled = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.spelling)
        ids = [t.id for t in self.whole.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, word: bytes) -> bytes:
        return np.array(self.whole.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, data: bytes) -> bytes:
        if _SPECIAL.encode() in data:  # what looks like a special token, for which capitals do matter
            return b"".join(self._whole(x) if _SPECIAL.encode() in x else self._one(x.lower()) for x in data.split())
        if len(self.young) >= REMEMBERED:
            self.young, self.old = {}, self.young
        words = data.lower().split()
        found = list(map(self.young.get, words))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self._one(words[k])
        return b"".join(found)

    def __call__(self, data: bytes) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._ids, pieces(data, SPACED))), "<u4")


# Kept for the tasks that a worker runs one after the other.
_encoders: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


@dataclass(frozen=True)
class Packing:
    size: int = SIZE
    sentence_cut: float = SENTENCE_CUT
    word_cut: float = WORD_CUT
    sequence: float = SEQUENCE

    def _places(self, stops: np.ndarray, sentences: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (from 0) where a window can end, and what a cut there costs."""
        stops = np.append(stops[stops < n], n)
        places = np.union1d(np.append(stops, 0), sentences)
        # Where nothing ends for long, cuts inside sentences are tried as well.
        step = max(1, self.size // 4)
        far = np.flatnonzero(np.diff(places) > step)
        extra = [np.arange(places[k] + step, places[k + 1], step) for k in far]
        places = np.union1d(places, np.concatenate(extra)) if extra else places
        costs = np.full(len(places), self.word_cut)
        costs[np.searchsorted(places, sentences)] = self.sentence_cut
        costs[np.searchsorted(places, stops)] = 0.0
        return places, costs

    def ends(self, stops: np.ndarray, sentences: np.ndarray, n: int, last: bool) -> list[int]:
        """Ends of the windows over ``n`` tokens with the least padding plus penalties.

        ``stops`` are ends of documents, ``sentences`` of sentences. If more follows
        (not ``last``), the padding of the final window doesn't count.
        """
        where, costs = self._places(stops, sentences, n)
        exact: dict[int, list[int]] = {}
        for k in range(self.size.bit_length()):
            j = np.searchsorted(where, where - (1 << k))
            for end in np.flatnonzero(where[j] == where - (1 << k)).tolist():
                exact.setdefault(end, []).append(int(j[end]))
        places, costs = where.tolist(), costs.tolist()
        cost, back = [0.0] * len(places), [0] * len(places)
        queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
        for k in range(1, len(places)):
            place = places[k]
            while queue[0][1] < place - self.size:
                queue.popleft()
            value, _, start = queue[0]
            best = value + self.size - place
            for j in exact.get(k, ()):
                if cost[j] < best:
                    best, start = cost[j], j
            best += self.sequence + costs[k]
            cost[k], back[k] = best, start
            value = best + place
            while queue and queue[-1][0] >= value:
                queue.pop()
            queue.append((value, place, k))
        k = len(places) - 1
        if not last:
            near = range(int(np.searchsorted(where, n - self.size)), k)
            back[k] = min(near, key=cost.__getitem__)
        ends = []
        while k:
            ends.append(places[k])
            k = back[k]
        return ends[::-1]

    def finish(self, begin: int, end: int) -> list[int]:
        """Ends of the sequences for a last window: powers of two where that is cheaper than its padding."""
        length = end - begin
        if (length.bit_count() - 1) * (self.word_cut + self.sequence) >= self.size - length:
            return [end]
        ends = []
        for k in range(length.bit_length() - 1, -1, -1):
            if length >> k & 1:
                begin += 1 << k
                ends.append(begin)
        return ends


class _Packer:
    """Documents of one task that are not packed yet, as a stream of ids."""

    def __init__(self, packing: Packing, closing: np.ndarray, sequence: int):
        self.packing, self.closing, self.sequence = packing, closing, sequence
        self.ids: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.waiting = 0
        self.packed = 0  # tokens of the first document that already went out

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids))
        self.waiting += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch:
        """Pieces of all windows; the final one waits for more unless this is the ``last`` call."""
        ids = np.concatenate(self.ids)
        stops = np.cumsum(self.sizes) - self.packed
        sentences = np.flatnonzero(self.closing[np.minimum(ids, len(self.closing) - 1)]) + 1
        ends = self.packing.ends(stops, sentences, len(ids), last)
        if last:
            ends = ends[:-1] + self.packing.finish(ends[-2] if len(ends) > 1 else 0, ends[-1])
        elif len(ends) > 1:
            ends.pop()
        opens = np.array([0, *ends])
        cuts = np.union1d(ends, stops[stops < ends[-1]])
        starts = np.concatenate(([0], cuts[:-1]))
        document = np.searchsorted(stops, starts, side="right")
        window = np.searchsorted(opens, starts, side="right") - 1
        before = np.concatenate(([0], stops))[document]
        before[document == 0] = -self.packed
        crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), cuts.tolist(), strict=True)]
        pieces = pa.RecordBatch.from_arrays(
            [
                pa.array([self.doc_ids[d] for d in document.tolist()], pa.int64()),
                pa.array(starts - before),
                pa.array(cuts - starts),
                pa.array(crcs, pa.int64()),
                pa.array(np.array(self.sizes, np.int64)[document]),
                pa.array(window + self.sequence),
                pa.array(starts - opens[window]),
            ],
            COLUMNS,
        )
        self.sequence += len(ends)
        done = int(np.searchsorted(stops, ends[-1], side="right"))
        self.packed = ends[-1] - (int(stops[done - 1]) if done else -self.packed)
        self.doc_ids, self.sizes = self.doc_ids[done:], self.sizes[done:]
        self.ids = [ids[ends[-1] :]]
        self.waiting = len(self.ids[0])
        return pieces


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str, packing: Packing = Packing(), end: int = END) -> DataFrame:
    """Pieces of sequences of at most ``packing.size`` tokens that hold all ids of all rows of ``docs``, once.

    A document is the ids of its text by the tokenizer file ``tokenizer`` (see
    ``WordIds``), then ``end``. Returns ``doc_id``, ``start`` (ids of the document
    before the piece), ``length``, ``ids_crc32`` (of the ids as little-endian unsigned
    32-bit numbers), ``doc_tokens``, ``sequence_id`` and ``offset`` (in the sequence).
    Order is that of the rows within a partition of ``docs``; sequences don't span
    partitions, whose last window becomes sequences of a power of two.

    A null or empty text is the id ``end`` alone. Repeated rows are packed each; a
    null ``doc_id`` stays null. An empty table gives no rows. A long text is held
    whole by a task, as about 8 bytes a token, and packed with its neighbours.
    Other columns are ignored.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        vocabulary = encode.whole.get_vocab()
        closing = np.zeros(max(vocabulary.values()) + 1, bool)
        closing[[k for token, k in vocabulary.items() if token.endswith((".</w>", "!</w>", "?</w>"))]] = True
        closing[end] = False
        packer = _Packer(packing, closing, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                packer.add(doc_id, np.append(encode(data), np.uint32(end)))
                if packer.waiting >= BLOCK_TOKENS:
                    yield packer.flush(last=False)
        if packer.waiting:
            yield packer.flush(last=True)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, ", ".join(f"{c} long" for c in COLUMNS)
    )
