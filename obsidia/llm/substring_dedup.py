"""Substring dedup over word windows, with a count-min prefilter.

1. Each window of ``length`` words is represented by its anchor, the gram of a few words that it owns by content. Every
   input partition counts the anchors of its windows in a count-min sketch of its own (``depth`` rows of ``width``
   saturating counters); the partition sketches are merged (``_sketch``). A count is never too low.
2. A second pass over the texts keeps the windows whose anchor is estimated to occur twice or more, and only those are
   grouped exactly (``_repeats``). Since estimates err upward only, no repeated window is lost; a sketch that is too
   small for the data merely lets more windows through.

The merged sketch that the second pass reads holds ``depth * width`` bits, whatever the input: 16 MB by default. That
is the only thing broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm import _sketch, _winnow, _words
from obsidia.llm._common import keyed, same_row, slices, utf8, written
from obsidia.llm._repeats import CLASS, RUNS, Unit, columns, covered_places, digests, flat_spans, level_spans, repeated_windows

_GRAM = 8


def _text_runs(batch: pa.RecordBatch, length: int) -> tuple[_words.Words, tuple[np.ndarray, ...]]:
    words = _words.split(*utf8(batch.column("text")))
    return words, _winnow.runs(words.hashes(), words.per_doc, length, min(_GRAM, length))


def _anchors_of(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (_text_runs(batch, length)[1][3] for batch in slices(batches, "text", 1 << 18))

    return run


def _estimated_runs(length: int, width: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            words, (doc, start, windows, anchor) = _text_runs(batch, length)
            keep = _sketch.maybe_twice(anchor, sketch.value, width)
            doc, start, windows, anchor = (x[keep] for x in (doc, start, windows, anchor))
            if not len(doc):
                continue
            first = (np.cumsum(words.per_doc) - words.per_doc)[doc] + start
            view = memoryview(words.flat)
            spans = zip(words.begin[first].tolist(), words.end[first + windows + length - 2].tolist())
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(anchor), *columns(digests(view[a:b] for a, b in spans))],
                names=["doc_id", "text_key", "start", "windows", *CLASS],
            )

    return run


def _split(pieces: list[bytes]) -> _words.Words:
    return _words.split(np.frombuffer(b"".join(pieces), dtype=np.uint8), np.array([len(p) for p in pieces]))


def _unit(length: int) -> Unit:
    def pieces(raw: bytes, runs: list[dict]) -> list[bytes]:
        w = _split([raw])
        data, begin, end = w.flat.tobytes(), w.begin, w.end
        return [data[begin[r["start"]] : end[r["start"] + r["windows"] + length - 2]] for r in runs]

    def windows(texts: list[bytes], counts: list[int]) -> Iterator[list[list[bytes]]]:
        w = _split(texts)
        data, begin, end = w.flat.tobytes(), w.begin.tolist(), w.end.tolist()
        first = 0
        for n in w.per_doc.tolist():
            yield [[data[begin[i] : end[i + length - 1]] for i in range(first, first + n - length + 1)]]
            first += n

    def repeats(texts: list[bytes], counts: list[int]) -> list[list[int]]:
        w = _split(texts)
        rolled = _winnow.gram_hashes(w.hashes(), length)
        _, inverse, n = np.unique(rolled, return_inverse=True, return_counts=True)
        twin = n[inverse] > 1  # no equal windows are missed; those across two pieces are not asked for
        data, begin, end = w.flat.tobytes(), w.begin.tolist(), w.end.tolist()
        seen: dict[bytes, int] = {}
        flags = np.zeros(len(w.begin), dtype=bool)
        first = 0
        for count in w.per_doc.tolist():
            for i in (np.flatnonzero(twin[first : first + count - length + 1]) + first).tolist():
                at = seen.setdefault(data[begin[i] : end[i + length - 1]], i)
                if at != i:
                    flags[at] = flags[i] = True
            first += count
        bounds = np.cumsum(w.per_doc)
        return [level_spans(flags[b - n : b]) for b, n in zip(bounds.tolist(), w.per_doc.tolist())]

    return Unit(1, pieces, repeats, windows)


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            w = _words.split(*utf8(batch.column("text")))
            gone = np.zeros(len(w.begin), dtype=bool)
            ends = np.cumsum(w.per_doc)
            for b, n, runs in zip((ends - w.per_doc).tolist(), w.per_doc.tolist(), batch.column("runs").to_pylist()):
                if runs:
                    gone[b : b + n] = covered_places(n, runs, length)
            data, begin, end = w.flat.tobytes(), w.begin.tolist(), w.end.tolist()
            removed, kept = [], []
            for b, n in zip((ends - w.per_doc).tolist(), w.per_doc.tolist()):
                mine = gone[b : b + n]
                removed.append(int(mine.sum()))
                edges = flat_spans(~mine)
                kept.append(b" ".join(data[begin[b + x] : end[b + y - 1]] for x, y in zip(edges[::2], edges[1::2])).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(w.per_doc, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "text_key", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeats(df: DataFrame, length: int = 35, id_col: str = "doc_id", text_col: str = "text", width: int = 1 << 26, depth: int = 2, hot: int = 2048) -> DataFrame:
    """One row per input row: ``doc_id, text_key, n_words, n_removed, kept`` (kept words joined by one space).

    A word goes if a window of ``length`` words covers it whose words also start anywhere else in the input; windows
    are judged on the input. Null texts have no words; shorter texts stay whole; rows that repeat count as occurrences
    of each other; other columns are ignored. ``width`` (a power of two) and ``depth`` (up to 4) size the sketch; they
    change how much the second pass sees, never its result.
    """
    width = _sketch.power_of_two(width)
    docs = keyed(df, id_col, text_col)
    sketch = _sketch.estimate(docs, _anchors_of(length), width, depth)
    shared = written(docs.mapInArrow(_estimated_runs(length, width, sketch), RUNS))
    spread = docs.repartition("doc_id")
    per_doc = repeated_windows(spread, shared, _unit(length), hot)
    joined = spread.alias("l").join(per_doc.alias("r"), same_row("l", "r"), "left").select("l.doc_id", "l.text_key", "l.text", "r.runs")
    return joined.mapInArrow(_cut(length), "doc_id long, text_key long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``: windows of 35 words."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
