"""Words of whole texts as flat numpy arrays.

Spark hands each task Arrow batches of texts.  The helpers here cut them into pieces of bounded
size, find word bounds with byte tables (all separators used are ASCII, so bytes decide), and
give every word a 64-bit hash.  Nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20  # a single longer text makes a piece of its own

_RANDOM = np.random.RandomState(20240607)
_BYTE_CODES = _RANDOM.randint(1, 1 << 62, size=(2, 256)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, hence invertible modulo 2**64
_STEPS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return a * _STEPS[lane] + b


@lru_cache(maxsize=4)
def _powers(size: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[lane]
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        out = np.ones(size, np.uint64)
        done, step = 1, b
        with np.errstate(over="ignore"):
            while done < size:
                more = min(done, size - done)
                out[done:done + more] = out[:more] * np.uint64(step)
                done += more
                step = step * step % (1 << 64)
        both.append(out)
    return both[0], both[1]


@dataclass
class Texts:
    """Texts of one piece: their bytes end to end; text i is data[at[i]:at[i + 1]]."""

    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1


def texts_of(column: pa.Array) -> Texts:
    """Nulls become empty texts."""
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(whole[at[0]:at[-1]], at - at[0])


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(np.asarray(size, dtype=np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


@dataclass
class Words:
    """Words of one piece.  Word i is bytes start[i]:end[i] of text doc[i]; the words of text d are
    first[d]:first[d + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self, lane: int = 0) -> np.ndarray:
        """64 bits from a word's bytes and length; equal words have equal hashes."""
        n = len(self.data)
        power, back = _powers(max(PIECE_BYTES + 1, n + 1), lane)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_CODES[lane][self.data] * power[:n], out=sums[1:])
            own = (sums[self.end] - sums[self.start]) * back[self.start]
        return mix(own ^ (self.end - self.start).astype(np.uint64))

    def room(self) -> np.ndarray:
        """How many words there are from each word to the end of its text."""
        return self.first[self.doc + 1] - np.arange(len(self.doc))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int, d: int) -> bytes:
        """Words i to j of text d, joined by single spaces."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j]))


def words_of(texts: Texts, word_bytes: np.ndarray, lower: bool) -> Words:
    data = LOWER[texts.data] if lower else texts.data
    inside = np.empty(len(data) + 1, bool)
    inside[:-1] = word_bytes[data]
    inside[-1] = False
    bounds = texts.at[1:-1]
    opens = inside[:-1].copy()
    opens[1:] &= ~inside[:-2]
    closes = inside[:-1] & ~inside[1:]
    # Texts lie end to end: a word also opens at the start of a text and closes at its end.
    cut = bounds[(bounds > 0) & (bounds < len(data))]
    opens[cut] = inside[cut]
    closes[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, texts.at)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, start, end, doc, first)


def grams(hashes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of the k words from each place on; meaningless where fewer than k are left in the text."""
    n = len(hashes)
    out = hashes.copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            out *= _STEPS[lane]
            if n > j:
                out[: n - j] += hashes[j:]
    return mix(out)
