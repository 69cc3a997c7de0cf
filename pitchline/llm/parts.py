"""Token ids of whole texts by their distinct parts: what two operators share, whatever encodes a part."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from pitchline.llm.text import ragged

#: Bytes that begin a character which a pre-tokenizer may take for a blank: the ASCII blanks and controls, and the lead bytes of
#: U+0085, U+00A0, U+1680, U+180E, U+2000 to U+205F and U+3000. Other characters with these lead bytes are only not cut before.
_MAY_BE_BLANK = np.zeros(256, bool)
_MAY_BE_BLANK[[*range(0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII but no letter: ends a run of letters.
_OTHER = ~_LETTER & (np.arange(256) < 128)


class Parts:
    """Remembers the ids of distinct parts, compared by their bytes; ``ids_of`` encodes a list of new ones.

    With ``cuts`` a text falls apart in front of a single space before a character that is no blank in Unicode, and between an ASCII
    letter and an ASCII character that is none: byte-level pre-tokenizers with the usual pattern always begin a piece there. A text
    that holds one of ``whole`` isn't cut.
    """

    LIMIT = 400_000                                    # parts remembered; beyond it the memory starts anew

    def __init__(self, ids_of: Callable[[list[bytes]], Iterable[list[int]]], cuts: bool, whole: list[bytes] = []) -> None:
        self.ids_of, self.cuts, self.whole = ids_of, cuts, whole
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.first, self.size, self.store, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _found(self, parts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The parts in some order, their ids in that order, and the number of ids of each."""
        found = list(self.ids_of(parts))
        size = np.fromiter(map(len, found), np.int64, len(found))
        return parts, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _learn(self, parts: list[bytes]) -> None:
        parts, flat, size = self._found(parts)
        if self.used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(len(self.store) + len(flat), np.uint32)])
        self.store[self.used:self.used + len(flat)] = flat
        self.number.update(zip(parts, range(len(self.size), len(self.size) + len(size))))
        self.first = np.concatenate([self.first, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(flat)

    def _edges(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where parts begin, and the end of the last."""
        begin = np.zeros(len(data) + 1, bool)
        if self.cuts:
            begin[:len(data) - 1] = (data[:-1] == 0x20) & ~_MAY_BE_BLANK[data[1:]]
            begin[bounds[1:][bounds[1:] > 0] - 1] = False      # a text's last space stands in front of nothing
            begin[1:len(data)] |= _LETTER[data[:-1]] & _OTHER[data[1:]]
            raw = data.tobytes() if self.whole else b""
            for token in self.whole:
                at = raw.find(token)
                while at >= 0:
                    d = int(np.searchsorted(bounds, at, "right")) - 1
                    begin[bounds[d]:bounds[d + 1]] = False
                    at = raw.find(token, int(bounds[d + 1]))
        begin[bounds] = True
        return np.flatnonzero(begin)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice, one after the other, and the number of ids of each."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        edges = self._edges(data, bounds)
        parts = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]) \
            .dictionary_encode()
        if len(self.number) > self.LIMIT:
            self._clear()
        known, number = parts.dictionary.to_pylist(), self.number
        numbers = np.fromiter(map(number.get, known, repeat(-1)), np.int64, len(known))
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            self._learn([known[i] for i in new])
            numbers[new] = [number[known[i]] for i in new]
        of = numbers[parts.indices.to_numpy(zero_copy_only=False)]
        sizes = self.size[of]
        ids = self.store[ragged(self.first[of], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(edges, bounds)]
        return ids, np.diff(ends)
