"""Count-min sketch of anchors in a whole table: which are estimated to occur twice. Estimates err upward only.

Input partitions report the cells they touch, four bytes each; reports are merged cell block by cell block over the
executors, in two levels where there are many partitions. What is left, ``depth * width`` bits, is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm import _winnow

_BLOCK = 1 << 20
#: Anchors that a partition gathers before it reports.
_GATHER = 1 << 21
#: Partitions whose reports one task merges, at most about.
_FAN = 256
_SEED = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
_REPORT = "row int, block int, part int, dense boolean, cells binary"


def _cells(anchors: np.ndarray, row: int, width: int) -> np.ndarray:
    return (_winnow.mix(anchors.view(np.uint64) * _SEED[row]) >> np.uint64(64 - (width.bit_length() - 1))).astype(np.int64)


def _record(row: int, block: int, part: int, dense: bool, cells: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([dense]), pa.array([cells], pa.binary())], names=["row", "block", "part", "dense", "cells"])


def _reports(anchors_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], width: int, depth: int):
    """Per row and block of cells: (cell << 1) | (whether this partition saw it twice)."""

    def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchors, part = np.concatenate(held), TaskContext.get().partitionId()
        for row in range(depth):
            cell, n = np.unique(_cells(anchors, row, width), return_counts=True)
            packed = ((cell % _BLOCK) << 1 | (n > 1)).astype(np.uint32)
            heads = np.flatnonzero(np.diff(cell // _BLOCK, prepend=-1))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(cell)]):
                yield _record(row, int(cell[a]) // _BLOCK, part, False, packed[a:b].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for anchors in anchors_of(batches):
            held.append(anchors)
            size += len(anchors)
            if size >= _GATHER:
                yield from told(held)
                held, size = [], 0
        if size:
            yield from told(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the reports of each block, up to two; rows come sorted by key."""
    key, once, twice = None, np.zeros(_BLOCK, dtype=bool), np.zeros(_BLOCK, dtype=bool)

    def done() -> pa.RecordBatch:
        return _record(*key, True, np.packbits(once).tobytes() + np.packbits(twice).tobytes())

    for batch in batches:
        for *this, dense, cells in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "part", "dense", "cells"))):
            if this != key:
                if key is not None:
                    yield done()
                key = this
                once[:] = twice[:] = False
            if dense:
                a, b = np.unpackbits(np.frombuffer(cells, dtype=np.uint8)).view(bool).reshape(2, _BLOCK)
                twice |= b | (once & a)
                once |= a
            else:
                x = np.frombuffer(cells, dtype=np.uint32)
                cell = x >> 1
                twice[cell] |= once[cell] | (x & 1 == 1)
                once[cell] = True
    if key is not None:
        yield done()


def estimate(docs: DataFrame, anchors_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], width: int, depth: int):
    """Broadcast bits (``depth`` rows) of cells that hold two or more; ``width`` is a power of two."""
    told = docs.select("text").mapInArrow(_reports(anchors_of, width, depth), _REPORT)

    def merged(reports: DataFrame) -> DataFrame:
        key = ["row", "block", "part"]
        return reports.repartition(*key).sortWithinPartitions(*key).mapInArrow(_merge, _REPORT)

    groups = -(-docs.rdd.getNumPartitions() // _FAN)
    if groups > 1:
        told = merged(told.withColumn("part", F.pmod("part", F.lit(groups))))
    bits = np.zeros((depth, max(_BLOCK, width) // 8), dtype=np.uint8)
    half = _BLOCK // 8
    for r in merged(told.withColumn("part", F.lit(0))).select("row", "block", F.substring("cells", half + 1, half).alias("twice")).collect():
        bits[r["row"], r["block"] * half : (r["block"] + 1) * half] = np.frombuffer(r["twice"], dtype=np.uint8)
    return docs.sparkSession.sparkContext.broadcast(bits)


def maybe_twice(anchors: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    """Which anchors may occur twice; none that does is left out."""
    keep = np.ones(len(anchors), dtype=bool)
    for row in range(len(bits)):
        cell = _cells(anchors, row, width)
        keep &= (bits[row, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return keep


def power_of_two(width: int) -> int:
    """The least power of two that isn't below ``width`` (256 at least)."""
    return 1 << (max(256, width) - 1).bit_length()
