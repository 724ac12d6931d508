"""Runs of bytes of different lengths, gathered from one buffer into another without a loop over the runs."""

from __future__ import annotations

import numpy as np


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Start of each run and, last, the end of all."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``data[start : start + length]`` one after the other."""
    ends = offsets(lengths)
    at = np.repeat(starts - ends[:-1], lengths)
    at += np.arange(ends[-1])
    return data[at]


class Runs:
    """Byte strings kept in one buffer, to be gathered by number."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(s) for s in strings], dtype=np.int64)
        self.starts = offsets(self.lengths)
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        return gather(self.data, self.starts[numbers], self.lengths[numbers])


def decimals(count: int, end: str) -> Runs:
    """The numbers below ``count`` in decimal, each followed by ``end``."""
    return Runs([f"{i}{end}".encode() for i in range(count)])
