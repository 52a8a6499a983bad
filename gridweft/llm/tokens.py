"""Words of whole texts as flat numpy arrays: a word is a run of bytes other than 0x20 and 0x09-0x0D.

All functions work on blocks of documents: one byte array and the offsets of the documents in it, as Arrow stores
them, so that no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + (1 << 16))
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        tables = []
        for base in (_MULTIPLIER, inverse):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = (tables[0], tables[1])
    return _powers


def text_blocks(column: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case; other bytes, and so other letters, are unchanged."""
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))


class Words:
    """The words of a block: ``start`` and ``end`` in its bytes, and ``first``: the first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR):
        """``separator``: which byte values stand between words."""
        self.data, self.offsets, self.separator = data, offsets, separator
        n = len(data)
        inside = ~separator[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begins[cuts] |= inside[cuts]
        ends[cuts - 1] |= inside[cuts - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        """The document of each word, as its place in the block."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes; equal words have equal hashes in every block."""
        n = len(self.data)
        power, inverse = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * power[:n], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * inverse[self.start]
        return mixed(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def array(self) -> pa.Array:
        """The words as an Arrow array of binary values."""
        canonical, offsets = self.joined(b"")
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(canonical)])

    def joined(self, sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes with ``sep`` (none or one byte) after each, and the place at which each word begins."""
        size = self.end - self.start
        begin = np.zeros(len(self) + 1, np.int64)
        np.cumsum(size + len(sep), out=begin[1:])
        keep = ~self.separator[self.data]
        if not sep:
            return self.data[keep], begin
        out = np.full(begin[-1], sep[0], np.uint8)
        gaps = np.ones(begin[-1], bool)
        gaps[begin[1:] - 1] = False
        out[gaps] = self.data[keep]
        return out, begin


def slices(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ``values`` from each start on, of each size, one after another, and where each begins."""
    begin = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    return values[np.arange(begin[-1]) + np.repeat(start - begin[:-1], size)], begin


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that begin at each place (the last n - 1 places have none)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mixed(out * np.uint64(0x9FB21C651E98DF25) + hashes[k : len(hashes) - n + 1 + k])
    return out


def whole_grams(first: np.ndarray, n: int) -> np.ndarray:
    """Places of a block at which an n-gram begins that lies in one document, from the first words of the documents."""
    total = int(first[-1])
    ends = np.repeat(first[1:], np.diff(first))
    places = np.arange(total)
    return places[places + n <= ends]
