"""Words and shingles of whole Arrow batches as numbers, computed in numpy.

A word is a run of bytes that are not ASCII white space (space, tab to carriage return), with A-Z lower-cased. It is
known by a 64-bit hash of its bytes and its length; a shingle by a 48-bit hash of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
# Bytes of text worked on at once: the arrays of a chunk stay in the cache of a core.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1 << 15

_U = np.uint64
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=_U)
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hash_bytes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices of ``data``, read eight bytes at a time."""
    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 8, dtype="<u8", buffer=padded.data, strides=(1,))
    left = lengths.astype(np.int64)
    out = mix(left.astype(_U) * _ODD ^ (eight[starts] & _MASKS[np.minimum(left, 8)]))
    at, active = starts + 8, np.flatnonzero(left > 8)
    left = left - 8
    while len(active):
        part = eight[at[active]] & _MASKS[np.minimum(left[active], 8)]
        out[active] = mix(out[active] * _ODD ^ part)
        at[active] += 8
        left[active] -= 8
        active = active[left[active] > 0]
    return out


@dataclass
class Words:
    """Words of some rows: hashes and byte spans of all words, and the first word of each row (one entry more)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(column: pa.Array, hashed: bool = True) -> Words:
    """Words of a string or binary column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = LOWER[data]
    n = len(data)
    gap = np.ones(n + 1, dtype=bool)
    gap[:n] = SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    inside = ~gap[:n]
    opens = inside.copy()
    opens[1:] &= gap[: n - 1] | edge[1:n]
    closes = inside & (gap[1:] | edge[1:])
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = hash_bytes(data, starts, ends - starts) if hashed else np.zeros(0, _U)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data)


def chunks(batch: pa.RecordBatch, *columns: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most CHUNK_BYTES in the columns (``text``), or a single row that is longer."""
    sizes = sum(
        pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for c in columns or ("text",)
    )
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = int(np.searchsorted(total, total[at] + CHUNK_BYTES, side="right")) - 1
        to = min(max(to, at + 1), at + CHUNK_ROWS, len(sizes))
        yield batch.slice(at, to - at)
        at = to


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, 48-bit hash) of each shingle of ``k`` words.

    A row of one to ``k - 1`` words has one shingle, all its words; a row without words has none.
    """
    n = len(words.hashes)
    ends = np.repeat(words.first[1:], np.diff(words.first))
    begins = np.repeat(words.first[:-1], np.diff(words.first))
    at = np.arange(n)
    total = words.hashes.copy()
    factor = 1
    for j in range(1, k):
        factor = factor * int(_ODD) % (1 << 64)
        shifted = np.zeros(n, dtype=_U)
        shifted[: max(n - j, 0)] = words.hashes[j:]
        shifted[at + j >= ends] = 0
        total += shifted * _U(factor)
    keep = np.flatnonzero((at + k <= ends) | (at == begins))
    return keep, mix(total[keep]) >> _U(16)
