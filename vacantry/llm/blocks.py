"""Array work on blocks of whole texts inside Arrow tasks: words, lines and their 64-bit hashes.

A block is a run of rows whose UTF-8 bytes lie in one buffer.  Rows are never cut, so a block holds at
least one row and otherwise at most ``BLOCK_BYTES``; memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RADIX = 0xD1342543DE82EF95


def byte_set(spec: Iterable[int]) -> np.ndarray:
    """Lookup table over byte values, true for the listed ones."""
    table = np.zeros(256, dtype=bool)
    table[list(spec)] = True
    return table


SPACE = byte_set([0x20, *range(0x09, 0x0E)])
NOT_SPACE = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
PLAIN = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES)
        for i, base in enumerate((_RADIX, pow(_RADIX, -1, 1 << 64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers


class Block:
    """Bytes of several texts; ``offsets[i]:offsets[i+1]`` is text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = PLAIN):
        self.raw = data
        self.data = data if fold is PLAIN else fold[data]
        self.offsets = offsets.astype(np.int64)
        self.n = len(offsets) - 1
        self._sums = None

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """Number of true bytes per text."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    def edges(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of member bytes; runs end with their text."""
        inside = member[self.data]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        first = self.offsets[:-1]
        first = first[first < len(inside)]
        before[first] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        last = self.offsets[1:] - 1
        after[last[last >= 0]] = False
        return starts, np.flatnonzero(inside & ~after) + 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range."""
        power, inverse = _power_tables(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(_VALUE[self.data] * power[:len(self.data)], out=self._sums[1:])
        span = (self._sums[ends] - self._sums[starts]) * inverse[starts]
        return mix(span + (ends - starts).astype(np.uint64) * _ODD)

    def bounds(self, starts: np.ndarray) -> np.ndarray:
        """Where each text's ranges begin in the list of ranges; one more entry ends the last."""
        return np.searchsorted(starts, self.offsets)


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``size`` neighbours within a text: (text index, first position, hash)."""
    n = np.maximum(np.diff(bounds) - size + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)
    return text, first, join_hashes(hashes, first, size)


def join_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hash of ``size`` neighbours from each first position."""
    out = np.full(len(first), size, dtype=np.uint64)
    for i in range(size):
        out = mix(out * _ODD + hashes[first + i]) if i == size - 1 else (out + hashes[first + i]) * _ODD
    return out


def keyed(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One key from the index of a text and a hash."""
    return mix(hashes + text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def text_array(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The texts of a batch with nulls as empty texts."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")


def blocks(batch: pa.RecordBatch, column: str, fold: np.ndarray = PLAIN,
           size: int = BLOCK_BYTES) -> Iterator[tuple[slice, Block]]:
    """Cuts a batch into blocks of whole texts; gives the rows of each and their bytes."""
    if not batch.num_rows:
        return
    array = text_array(batch, column)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(array):
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), len(array))
        yield slice(at, end), Block(data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at], fold)
        at = end
