"""Words of whole Arrow string columns as numpy arrays: positions, 64-bit hashes, documents they belong to.

A batch is cut into slices of whole documents of about ``SLICE`` bytes, so memory follows the slice (or one long
document), never the batch. All hashes are functions of the bytes alone: every task, run and machine agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
BASE = 0x9E3779B97F4A7C15            # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)

SPACE, WORD, MARK = 0, 1, 2
#: Words are whatever lies between the six ASCII white-space bytes.
BLANKS = np.ones(256, np.uint8)
BLANKS[[0x20, *range(0x09, 0x0E)]] = SPACE
#: Words are runs of letters, digits and bytes of multi-byte characters; other visible characters form runs of marks.
RUNS = np.where(BLANKS == SPACE, SPACE, MARK).astype(np.uint8)
for low, high in ((48, 57), (65, 90), (95, 95), (97, 122), (128, 255)):
    RUNS[low:high + 1] = WORD
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i modulo 2**64 for i < n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (BASE, INVERSE):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers = (out[0], out[1])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, from one running polynomial sum."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:-1], out=total[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + length * np.uint64(0x632BE59BD9B4E019))


@dataclass
class Words:
    """Words of several documents in order. ``first[d]:first[d + 1]`` are the words of document d."""

    data: np.ndarray          # bytes of the slice
    bounds: np.ndarray        # byte offsets of the documents, one more than documents
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    kinds: np.ndarray         # class of each word

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, fold: np.ndarray = SAME) -> np.ndarray:
        return range_hashes(fold[self.data].astype(np.uint64) + np.uint64(1), self.starts, self.ends)


def cut(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray = BLANKS) -> Words:
    kind = classes[data]
    n = len(kind)
    change = np.ones(n + 1, bool)
    if n:
        change[1:n] = kind[1:] != kind[:-1]
    change[bounds] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    if n == 0:
        starts = ends = np.zeros(0, np.int64)
    visible = kind[starts] != SPACE
    starts, ends = starts[visible], ends[visible]
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds), kind[starts])


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, one past the last, bytes, byte bounds) of consecutive slices; nulls are empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high, whole[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers start, start + 1, ... of every range, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list per row holding the next ``counts`` values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
