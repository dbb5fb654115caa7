"""Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts laid end to end, found with array operations only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from obsidia.llm import _winnow

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """``flat``: the words with one space after each, documents end to end; ``begin`` and ``end``: each word's bytes."""

    flat: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    per_doc: np.ndarray

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit hash of each word."""
        if not len(self.begin):
            return np.zeros(0, dtype=np.uint64)
        sums = _winnow.prefix_hashes(_winnow.byte_values(self.flat))
        _, down = _winnow._power_tables(len(self.flat) + 1)
        return _winnow.mix((sums[self.end] - sums[self.begin]) * down[self.begin] + (self.end - self.begin).astype(np.uint64))

    def prefixes(self, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size, the words of that many bytes at least and a mixed hash of so many first ones."""
        if not len(self.begin):
            return [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)) for _ in sizes]
        sums = _winnow.prefix_hashes(_winnow.byte_values(self.flat))
        _, down = _winnow._power_tables(len(self.flat) + 1)
        out = []
        for size in sizes:
            at = np.flatnonzero(self.end - self.begin >= size)
            begin = self.begin[at]
            out.append((at, _winnow.mix((sums[begin + size] - sums[begin]) * down[begin] + np.uint64(size << 32))))
        return out


def split(data: np.ndarray, lengths: np.ndarray) -> Words:
    """Words of each document; a document's end also ends its last word."""
    lengths = np.asarray(lengths, dtype=np.int64)
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return Words(data, empty, empty, np.zeros(len(lengths), dtype=np.int64))
    word = ~_SPACE[data]
    ends = np.cumsum(lengths)
    head = word.copy()
    head[1:] &= ~word[:-1]
    edge = (ends - lengths)[lengths > 0]
    head[edge] = word[edge]
    begin = np.flatnonzero(head)
    counts = np.diff(np.concatenate([[0], np.searchsorted(begin, ends)]))
    # every word moves right by the words before it and left by the white space before it
    number = np.cumsum(head)
    kept = np.flatnonzero(word)
    place = np.cumsum(word)[kept] - 1 + number[kept] - 1
    flat = np.full(len(kept) + len(begin), 0x20, dtype=np.uint8)
    flat[place] = data[kept]
    size = np.diff(np.append(np.searchsorted(kept, begin), len(kept)))
    end = np.cumsum(size + 1) - 1
    return Words(flat, end - size, end, counts)
