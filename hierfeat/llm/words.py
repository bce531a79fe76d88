"""Words of many texts at once, on the UTF-8 bytes of an Arrow column.

A word is a run of characters other than space and the control characters 9 to 13. All
of these are single bytes, so words can be cut on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; the finalizer of MurmurHash3 (fixed values)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))


def powers(n: int, base: np.uint64) -> np.ndarray:
    """1, base, base², … modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Runs of rows of about ``most`` bytes; a longer text is a run of its own. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = done = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield texts.slice(start, stop - start)
        done, start = int(ends[stop - 1]), stop


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a piece in a row, and the bounds of each text in them."""
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data if data is not None else b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    """Where the words of a piece start and end, and the text each belongs to."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray

    @property
    def firsts(self) -> np.ndarray:
        """Index of the first word of each text."""
        return np.concatenate([[0], np.cumsum(self.counts)[:-1]])


def words_of(data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """The runs of bytes between those that ``space`` marks, by default the words."""
    solid = ~space[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | cut[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    # Empty texts share a bound with the next one; the last text at a bound holds the word.
    doc = np.searchsorted(bounds[1:], starts, "right")
    return Words(data, starts, ends, doc, np.bincount(doc, minlength=len(bounds) - 1))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    lengths = w.ends - w.starts
    power = powers(int(lengths.max()), STEP)
    # The numbers of a long text are made a part at a time.
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // PIECE_BYTES)) + 1
    found = []
    for starts, size in zip(np.split(w.starts, cuts), np.split(lengths, cuts)):
        heads = np.concatenate([[0], np.cumsum(size)[:-1]])
        inside = np.arange(int(size.sum())) - np.repeat(heads, size)
        terms = BYTE_VALUE[w.data[inside + np.repeat(starts, size)]] * power[inside]
        found.append(np.add.reduceat(terms, heads))
    return mixed(np.concatenate(found))
