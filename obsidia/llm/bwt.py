"""Repeated windows of a small text by bounded interval expansion on its Burrows-Wheeler transform.

The transform comes from sorting cyclic suffixes by their first ``length`` symbols, which is all that intervals of
strings up to that length need. Starting from the empty string's interval, every interval of a string w is extended
backward by each symbol c that precedes it; the right border of the interval of cw gets the common-prefix value |w|
unless a shorter string has set it before. Levels run breadth-first, so values come out in increasing order, and the
expansion stops at ``length``: borders still unset join suffixes that share at least ``length`` symbols.
"""

from __future__ import annotations

import numpy as np


def _inverse(keys: np.ndarray, bound: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Dense ranks of keys below ``bound``, how many differ, and an order; packed with positions where that fits."""
    bits = max(1, (len(keys) - 1).bit_length())
    if bound.bit_length() + bits <= 63:
        packed = np.sort((keys << bits) | np.arange(len(keys)))
        order, ordered = packed & ((1 << bits) - 1), packed >> bits
    else:
        order = np.argsort(keys)
        ordered = keys[order]
    new = np.empty(len(keys), dtype=bool)
    new[0] = False
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    ranks = np.empty(len(keys), dtype=np.int64)
    ranks[order] = np.cumsum(new)
    return ranks, int(new.sum()) + 1, order


def sort_cyclic(codes: np.ndarray, length: int) -> np.ndarray:
    """Positions of a cyclic text ordered by the ``length`` symbols from each; ties in any order."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length())
    step = min(max(1, (63 - (n - 1).bit_length()) // bits), length)
    wide = np.concatenate([codes, codes[: step - 1]] if step <= n else [np.resize(codes, n + step - 1)]).astype(np.int64)
    keys = np.zeros(n, dtype=np.int64)
    for i in range(step):
        keys = (keys << bits) | wide[i : i + n]
    ranks, distinct, order = _inverse(keys, 1 << (bits * step))
    depth = step
    while depth < length and distinct < n:
        ahead = min(depth, length - depth)
        ranks, distinct, order = _inverse(ranks * distinct + np.roll(ranks, -(ahead % n)), distinct * distinct)
        depth += ahead
    return order


class _Backward:
    """Stable radix passes over the transform: where each interval goes when one symbol is put before its string."""

    def __init__(self, transform: np.ndarray):
        self.passes, current = [], transform
        for bit in range(max(1, int(transform.max()).bit_length())):
            ones = ((current >> bit) & 1).astype(bool)
            ranks = np.zeros(len(current) + 1, dtype=np.int32)
            np.cumsum(ones, out=ranks[1:])
            self.passes.append((ranks, len(current) - int(ranks[-1])))
            current = np.concatenate([current[~ones], current[ones]])

    def extend(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for ranks, zeros in self.passes:
            a, b = ranks[low], ranks[high]
            low, high = np.concatenate([low - a, zeros + a]), np.concatenate([high - b, zeros + b])
            some = low < high
            low, high = low[some], high[some]
        return low, high


def common_prefixes(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and, for each suffix, its common prefix with the one before, cut off at ``length``."""
    n = len(codes)
    order = sort_cyclic(codes, length)
    value = np.full(n + 1, length, dtype=np.int32)
    unset = np.ones(n + 1, dtype=bool)
    value[0], unset[0] = 0, False
    backward = _Backward(codes[order - 1])
    low, high = np.zeros(1, dtype=np.int32), np.full(1, n, dtype=np.int32)
    unset[n] = True  # the last border is set at the first level
    for level in range(length):
        low, high = backward.extend(low, high)
        fresh = unset[high]
        low, high = low[fresh], high[fresh]
        # of intervals that end at one border only one string of each length exists, so borders are distinct here
        value[high], unset[high] = level, False
        if not len(low):
            break
    return order, value[:n]


def repeated(texts: list[bytes], lengths: tuple[int, ...], counts: list[int]) -> list[list[np.ndarray]]:
    """For each text and each of the lengths, which of its first so many positions start a string of that length that
    also starts at another such position of any text, itself included."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(data), dtype=bool)
    inside[starts + sizes] = False
    present = np.zeros(256, dtype=bool)
    present[data[inside]] = True
    table = np.zeros(256, dtype=np.int64)
    table[present] = np.arange(1, int(present.sum()) + 1)
    codes = np.where(inside, table[data], 0)
    codes = codes.astype(np.uint8 if codes.max() < 256 else np.uint16)
    order, value = common_prefixes(codes, max(lengths))
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for length in lengths:
        asked = np.minimum(counts, np.maximum(sizes - length + 1, 0))
        edge = np.zeros(len(codes) + 1, dtype=np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + asked, -1)
        mine = np.cumsum(edge[:-1])[order] > 0
        group = np.cumsum(value < length)
        twice = np.zeros(len(codes), dtype=bool)
        twice[order[mine & (np.bincount(group, mine)[group] > 1)]] = True
        for o, s, n in zip(out, starts.tolist(), asked.tolist()):
            o.append(twice[s : s + n])
    return out
