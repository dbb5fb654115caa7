"""From runs of windows to the repeated windows of each document; shared by the two substring dedups.

A run is ``doc_id, text_key, start, windows, anchor, d1, d2``: windows in a row that own one anchor, and a 128-bit
digest of all they span (its *piece*). Equal windows own equal anchors, so an anchor's *bucket* holds every occurrence of
each of its windows. Equal runs form a class and are counted before the bucket is shuffled; only one text of each class
travels. Windows may have several lengths, called levels: those of one start have the shortest one's anchor, and pieces
reach to the end of the longest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm._common import same_row, slices, written

RUNS = "doc_id long, text_key long, start int, windows int, anchor long, d1 long, d2 long"
CLASS = ["anchor", "d1", "d2"]
_PIECE = "anchor long, d1 long, d2 long, windows int, piece binary"
#: Bytes of a bucket batch that one call of ``repeats`` gets.
BATCH = 900_000


@dataclass
class Unit:
    """How one kind of window works.

    ``levels``: how many lengths; ``pieces(raw, runs)``: the bytes that each run spans; ``repeats(pieces, counts)``: for
    each piece, of so many windows, flat [level, first, end, ...] spans of the windows that occur twice among all pieces; ``windows(pieces, counts)``: for each piece and level, the bytes of each window.
    """

    levels: int
    pieces: Callable[[bytes, list[dict]], list[bytes]]
    repeats: Callable[[list[bytes], list[int]], list[list[int]]]
    windows: Callable[[list[bytes], list[int]], Iterator[list[list[bytes]]]]


def digests(pieces: Iterable[bytes]) -> np.ndarray:
    """128-bit digests as two int64 columns."""
    return np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in pieces), dtype=np.int64).reshape(-1, 2)


def columns(digest: np.ndarray) -> list[pa.Array]:
    """The two columns of ``digests`` for Arrow."""
    return [pa.array(np.ascontiguousarray(digest[:, k])) for k in (0, 1)]


def flat_spans(flags: np.ndarray) -> list[int]:
    """``[first, end, ...]`` of the true stretches."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


def level_spans(flags: np.ndarray, level: int = 0, ahead: int = 0) -> list[int]:
    """``[level, first, end, ...]`` of the true stretches, counted from ``ahead``."""
    edges = flat_spans(flags)
    return [x for a, b in zip(edges[::2], edges[1::2]) for x in (level, ahead + a, ahead + b)]


def _extract(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            keys: list[list[int]] = [[], [], [], []]
            found: list[bytes] = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("listed").to_pylist()):
                for r in runs:
                    for k, name in zip(keys, (*CLASS, "windows")):
                        k.append(r[name])
                found += unit.pieces((text or "").encode(), runs)
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys[:3]), pa.array(keys[3], pa.int32()), pa.array(found, pa.binary())], names=[*CLASS, "windows", "piece"])

    return run


def _expand(unit: Unit):
    """Repeated windows of whole buckets; rows come sorted by anchor, and a bucket is never cut."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        spans = unit.repeats([x[4] for x in held], [x[3] for x in held])
        some = [i for i, s in enumerate(spans) if s]
        return pa.RecordBatch.from_arrays(
            [*(pa.array([held[i][k] for i in some], pa.int64()) for k in range(3)), pa.array([spans[i] for i in some], pa.list_(pa.int32()))],
            names=[*CLASS, "spans"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*CLASS, "windows", "piece"))):
                if size >= BATCH and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield solve(held)

    return run


def _window_digests(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "piece", 1 << 17):
            each = list(unit.windows(batch.column("piece").to_pylist(), batch.column("windows").to_pylist()))
            for level in range(unit.levels):
                counts = [len(x[level]) for x in each]
                at = pa.array(np.repeat(np.arange(len(each)), counts))
                offset = pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in counts]))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(at) for c in CLASS), pa.array(np.full(sum(counts), level, dtype=np.int32)), offset, *columns(digests(w for x in each for w in x[level]))],
                    names=[*CLASS, "level", "at", "w1", "w2"],
                )

    return run


def repeated_windows(spread: DataFrame, shared: DataFrame, unit: Unit, hot: int) -> DataFrame:
    """``doc_id, text_key, runs array<struct<start, windows, spans>>`` for documents with repeated windows.

    ``spread`` has ``doc_id, text_key, text`` and may have others, which are read along: a caller that joins all of its
    columns with the result then shares the shuffle. ``shared`` has the runs of every anchor that
    occurs twice, and may have others. ``spans``, [level, first, end, ...], is null where all of a run's windows repeat. Buckets of up to ``hot``
    classes are solved one at a time in a task; the windows of larger ones are grouped by digest over all executors.
    """
    classes = shared.groupBy(*CLASS).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start", "windows")).alias("one"))
    width = classes.groupBy("anchor").agg(F.count("*").alias("different"), F.sum("n").alias("total")).where("total > 1").drop("total")
    judged = written(classes.join(width, "anchor"), compression="zstd")
    along = [F.col(f"l.{c}") for c in spread.columns if c not in ("doc_id", "text_key")]
    mixed = judged.where("different > 1").select("one.doc_id", "one.text_key", "one.start", "one.windows", *CLASS, "different")

    def pieces(part: DataFrame) -> DataFrame:
        listed = part.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "windows", *CLASS)).alias("listed"))
        joined = spread.alias("l").join(listed.alias("r"), same_row("l", "r")).select(*along, "r.listed")
        # rows alike in id and text give the same pieces again
        return joined.mapInArrow(_extract(unit), _PIECE)

    cold = pieces(mixed.where(F.col("different") <= hot)).repartition("anchor").dropDuplicates(CLASS).sortWithinPartitions("anchor")
    found = cold.mapInArrow(_expand(unit), "anchor long, d1 long, d2 long, spans array<int>")
    if judged.where(F.col("different") > hot).limit(1).count():
        windows = pieces(mixed.where(F.col("different") > hot)).dropDuplicates(CLASS).mapInArrow(_window_digests(unit), "anchor long, d1 long, d2 long, level int, at int, w1 long, w2 long")
        again = windows.groupBy("level", "w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        offsets = windows.join(again, ["level", "w1", "w2"], "left_semi").groupBy(*CLASS).agg(F.collect_list(F.array("level", "at", F.col("at") + 1)).alias("at"))
        found = found.unionByName(offsets.select(*CLASS, F.flatten("at").alias("spans")))

    whole = judged.where("n > 1").select(*CLASS, F.lit(None).cast("array<int>").alias("spans"))
    marks = whole.unionByName(found.join(judged.where("n = 1").select(*CLASS), CLASS, "left_semi"))
    return shared.join(marks, CLASS).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "windows", "spans")).alias("runs"))


def covered_places(n: int, runs: list[dict], length: int, level: int = 0) -> np.ndarray:
    """Which of a document's n symbols the repeated windows of a level, of ``length`` symbols, cover."""
    change = np.zeros(n + 1, dtype=np.int32)
    first, last = [], []
    for r in runs:
        s = r["spans"] if r["spans"] is not None else [level, 0, min(r["windows"], n - length + 1 - r["start"])]
        for which, a, e in zip(s[::3], s[1::3], s[2::3]):
            if which == level and a < e:
                first.append(r["start"] + a)
                last.append(r["start"] + e - 1 + length)
    np.add.at(change, np.array(first, dtype=np.int64), 1)
    np.add.at(change, np.array(last, dtype=np.int64), -1)
    return np.cumsum(change[:n]) > 0
