"""Words of many texts at once, with NumPy over Arrow's byte buffers.

Texts are taken whole, in blocks of about BLOCK_BYTES; a longer text makes a block of its own.
Words are spans of bytes, so nothing is made for each word but numbers. 64-bit hashes stand for
words and for runs of words: a polynomial of the bytes, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

#: Bytes of words `[^\x20\x09-\x0D]+`.
BLACK = np.ones(256, bool)
BLACK[[0x20, *range(0x09, 0x0E)]] = False

#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C55
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    kept = _powers.get(base)
    if kept is None or len(kept[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        kept = (out[0], out[1])
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = kept
    return kept


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair of positions."""
    power, inverse = _powers_of(base, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * power[: len(values)], out=total[1:])
    return mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Block:
    """Some whole texts: rows[i] is the i-th text's row in the batch; the words of text i are first[i]:first[i + 1]."""

    rows: range
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        return run_hashes(self.data if fold is None else fold[self.data], self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        """For each word, the index of its text in the block."""
        return np.repeat(np.arange(len(self.rows)), self.counts())


def _cut(data: np.ndarray, offsets: np.ndarray, rows: range, black: np.ndarray) -> Block:
    offsets = offsets - offsets[0]
    inside = black[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    start = np.flatnonzero(after & (~before | edge))
    end = np.flatnonzero(before & (~after | edge))
    return Block(rows, data, offsets, start, end, np.searchsorted(start, offsets))


def blocks(texts: pa.Array, black: np.ndarray = BLACK) -> Iterator[Block]:
    """Blocks over an Arrow column of strings; null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + BLOCK_BYTES, "right")) - 1)
        high = min(high, n)
        yield _cut(data[offsets[low] : offsets[high]], offsets[low : high + 1], range(low, high), black)
        low = high


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """An Arrow column of lists of 64-bit integers."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int64, copy=False)))
