"""Content-sampled anchors: every window of a fixed length owns exactly one anchor, and equal windows own equal anchors.

A window of ``length`` symbols holds ``length - gram + 1`` grams; its anchor is the leftmost gram whose mixed hash is
least. The choice depends on the window's content alone, so two equal windows anywhere in the corpus choose the same
gram at the same place. Consecutive windows mostly share their anchor, so a document turns into a few *runs*: an anchor
hash, the first window that owns it and how many windows in a row do. All functions work on one concatenated buffer.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_POSITION_BITS = 26
_POSITION = np.uint64((1 << _POSITION_BITS) - 1)
#: Symbols that ``runs`` works on at once; positions are packed beside hashes, so 2**26 at most.
MAX_BUFFER = 1 << 22


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = np.uint64(1)
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all of them."""
    h = h ^ (h >> np.uint64(33))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i`` modulo 2**64, with a leading zero."""
    up, _ = _power_tables(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Mixed hash of each run of ``gram`` values, by its start; empty when there are too few."""
    n = len(values) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = prefix_hashes(values)
    _, down = _power_tables(len(values) + 1)
    return mix((sums[gram:] - sums[:n]) * down[:n])


def byte_values(buffer: np.ndarray) -> np.ndarray:
    """Random 64-bit values of bytes, the input of the rolling hashes."""
    return _byte_values()[buffer]


def window_anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Position of the least gram among ``width`` in a row, by the first one's position; the leftmost wins ties."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(keys)] = keys
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _POSITION).astype(np.int64)


def runs(values: np.ndarray, lengths: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that own one anchor, for documents laid end to end.

    Returns document index, first window's start within the document, number of windows and anchor hash (int64).
    Beyond ``MAX_BUFFER`` symbols documents are cut into stretches that overlap by ``length - 1``. A run may end where a
    stretch does; its windows keep their anchors.
    """
    if len(values) <= MAX_BUFFER:
        return _runs(values, lengths, length, gram)
    step = max(1, MAX_BUFFER - length + 1)
    found = []
    for d, (begin, n) in enumerate(zip((np.cumsum(lengths) - lengths).tolist(), lengths.tolist())):
        for at in range(0, n - length + 1, step):
            part = values[begin + at : begin + min(n, at + step + length - 1)]
            _, start, windows, anchor = _runs(part, np.array([len(part)]), length, gram)
            found.append((np.full(len(start), d), start + at, windows, anchor))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, dtype=np.int64),) * 4


def _runs(values: np.ndarray, lengths: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    ends = np.cumsum(lengths)
    starts = ends - lengths
    grams = gram_hashes(values, gram)
    anchors = window_anchors(grams, length - gram + 1)
    n_windows = np.maximum(lengths - length + 1, 0)
    total = int(n_windows.sum())
    if not total:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty
    doc = np.repeat(np.arange(len(lengths)), n_windows)
    first = np.cumsum(n_windows) - n_windows
    at = np.arange(total) - np.repeat(first - starts, n_windows)
    anchor = anchors[at]
    new = np.ones(total, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, total))
    return doc[heads], at[heads] - starts[doc[heads]], counts, grams[anchor[heads]].view(np.int64)
