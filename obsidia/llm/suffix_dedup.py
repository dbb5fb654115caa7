"""Suffix-array dedup: remove every byte that a repeated string of ``length`` bytes covers.

1. Each window of ``length`` bytes is owned by a content-chosen anchor (``_winnow``); a document becomes runs of windows
   (anchor hash, 128-bit digest of the run's bytes). Equal windows have equal anchors, so only anchors that occur twice
   can own a repeated window, and all occurrences of one meet in one anchor's bucket. A count-min sketch (``_sketch``)
   of all anchors leaves most of the others out before anything is written.
2. Runs that are equal to the byte repeat as a whole. They are counted before anything is shuffled by bucket, so
   thousands of copies arrive as one class.
3. In the buckets that hold different runs, one text of each class goes through bounded interval expansion on a
   Burrows-Wheeler transform (``bwt``), a megabyte at a time, after windows whose rolling hash is alone are cut away.
   A bucket of more than ``hot`` classes would not fit one task: its windows are grouped exactly by 128-bit digests.
4. The covered windows of each class go back to all its runs and from there to the documents.

No step gathers a bucket, a document's copies or the classes on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm import _sketch, _winnow, bwt
from obsidia.llm._common import keyed, ranges, same_row, slices, utf8, written
from obsidia.llm._repeats import CLASS, RUNS, Unit, columns, covered_places, digests, flat_spans, level_spans, repeated_windows

_GRAM_SHARE = 0.16


def _anchors_of(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in slices(batches, "text", 1 << 18):
            data, lengths = utf8(batch.column("text"))
            yield _winnow.runs(_winnow.byte_values(data), lengths, length, gram)[3]

    return run


def _find_runs(length: int, reach: int, gram: int, width: int, sketch):
    """Runs of windows of ``length`` bytes whose anchors may occur twice; digests are of all that ``reach`` bytes span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            data, lengths = utf8(batch.column("text"))
            doc, start, windows, anchor = _winnow.runs(_winnow.byte_values(data), lengths, length, gram)
            keep = _sketch.maybe_twice(anchor, sketch.value, width)
            doc, start, windows, anchor = (x[keep] for x in (doc, start, windows, anchor))
            if not len(doc):
                continue
            ends = np.cumsum(lengths)
            begin = (ends - lengths)[doc] + start
            view = memoryview(data)
            digest = digests(view[a:b] for a, b in zip(begin.tolist(), np.minimum(begin + windows + reach - 1, ends[doc]).tolist()))
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(anchor), *columns(digest)],
                names=["doc_id", "text_key", "start", "windows", *CLASS],
            )

    return run


def _unit(lengths: tuple[int, ...]) -> Unit:
    short, reach = min(lengths), max(lengths)

    def pieces(raw: bytes, runs: list[dict]) -> list[bytes]:
        return [raw[r["start"] : r["start"] + r["windows"] + reach - 1] for r in runs]

    def windows(texts: list[bytes], counts: list[int]) -> Iterator[list[list[bytes]]]:
        return ([[t[i : i + n] for i in range(min(c, len(t) - n + 1))] for n in lengths] for t, c in zip(texts, counts))

    def repeats(texts: list[bytes], counts: list[int]) -> list[list[int]]:
        sizes, many = np.array([len(t) for t in texts]), np.array(counts)
        starts = np.cumsum(sizes) - sizes
        hashes = _winnow.gram_hashes(_winnow.byte_values(np.frombuffer(b"".join(texts), dtype=np.uint8)), short)
        own = hashes[ranges(starts, many)]
        order = np.argsort(own)
        same = own[order[1:]] == own[order[:-1]]
        twin = np.zeros(len(own), dtype=bool)
        twin[order[1:][same]] = twin[order[:-1][same]] = True
        out: list[list[int]] = [[] for _ in texts]
        cut, held, where = [], [], []
        first = np.cumsum(many) - many
        for i, t in enumerate(texts):
            edges = flat_spans(twin[first[i] : first[i] + many[i]])
            for a, b in zip(edges[::2], edges[1::2]):
                cut.append(t[a : b + reach - 1])
                held.append(b - a)
                where.append((i, a))
        for (i, a), levels in zip(where, bwt.repeated(cut, lengths, held)):
            for level, flags in enumerate(levels):
                out[i] += level_spans(flags, level, a)
        return out

    return Unit(len(lengths), pieces, repeats, windows)


def _whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Bytes to keep so that a character goes as soon as one of its bytes does."""
    head = (raw & 0xC0) != 0x80
    return ~np.logical_or.reduceat(gone, np.flatnonzero(head))[np.cumsum(head) - 1] if len(raw) else ~gone


def _cut(lengths: tuple[int, ...], as_text: bool):
    """Covered bytes of each text from its runs' repeated windows; what is left of it; bytes that the last length covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 22):
            data, sizes = utf8(batch.column("text"))
            begin = np.cumsum(sizes) - sizes
            removed, spans, kept, marked = [], [], [], []
            for b, n, runs in zip(begin.tolist(), sizes.tolist(), batch.column("runs").to_pylist()):
                raw = data[b : b + n]
                gone = covered_places(n, runs or [], lengths[0])
                marked.append(int(covered_places(n, runs or [], lengths[-1], len(lengths) - 1).sum()))
                edges = flat_spans(gone)
                removed.append(int(gone.sum()))
                spans.append([{"start": a, "end": e} for a, e in zip(edges[::2], edges[1::2])])
                kept.append(raw[_whole_characters(raw, gone) if as_text and edges else ~gone].tobytes())
            carried = [c for c in batch.schema.names if c == "carried"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ("doc_id", "text_key", *carried)), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string()) if as_text else pa.array(kept, pa.binary()), pa.array(marked, pa.int64())],
                names=["doc_id", "text_key", *carried, "n_bytes", "n_removed", "spans", "kept", "n_marked"],
            )

    return run


def remove_repeats(df: DataFrame, length: int = 400, mark: int | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = 2048, as_text: bool = False, width: int = 1 << 26, depth: int = 2, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: ``doc_id, text_key, n_bytes, n_removed, spans array<struct<start,end>>, kept binary,
    n_marked``.

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else in the input; strings are
    judged on the input. Null texts are empty; texts shorter than ``length`` stay whole; rows that repeat count as
    occurrences of each other; null ids are an id like any other; other columns are ignored.
    With ``as_text``, ``kept`` is a string, without the characters that a removed byte belonged to.
    ``n_marked`` counts the bytes that repeated strings of ``mark`` bytes cover (at most ``length``, which it is by
    default): passages too short to go are told, not cut. ``width`` (a power of two) and ``depth`` (up to 4) size the
    sketch; they change how many runs are written, never the result. Columns in ``carry`` come along in a struct,
    ``carried``.
    """
    lengths = (length,) if mark is None or mark >= length else (length, mark)
    gram, width = max(1, min(128, round(min(lengths) * _GRAM_SHARE))), _sketch.power_of_two(width)
    docs = keyed(df, id_col, text_col)
    sketch = _sketch.estimate(docs, _anchors_of(min(lengths), gram), width, depth)
    shared = written(docs.mapInArrow(_find_runs(min(lengths), length, gram, width, sketch), RUNS), compression="zstd")
    whole = docs if not carry else keyed(df, id_col, text_col, carried=F.struct(*carry))
    # not partitioned here: both joins with it ask for the same keys and columns, so that texts are shuffled once
    per_doc = repeated_windows(whole, shared, _unit(lengths), hot)
    joined = whole.alias("l").join(per_doc.alias("r"), same_row("l", "r"), "left").select("l.doc_id", "l.text_key", *(["l.carried"] if carry else []), "l.text", "r.runs")
    kind = "string" if as_text else "binary"
    more = f" carried {whole.schema['carried'].dataType.simpleString()}," if carry else ""
    return joined.mapInArrow(_cut(lengths, as_text), f"doc_id long, text_key long,{more} n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept {kind}, n_marked long")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``: strings of 400 bytes go. A further column, ``n_marked``, counts the
    bytes of passages that repeat over 300 bytes or more, about 50 words, which the contract's length leaves in place."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), mark=300)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_marked")
