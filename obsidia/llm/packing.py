"""Packing under mixture control: deficit round-robin over one token queue per source.

Each source's documents, tokenised and ended by an end id, form a queue of tokens. Queues are served in quanta: a
source's k-th quantum is due when (k + 1/2) / weight rounds have passed, so over any stretch of windows each queue has
got its target share but for a deficit of less than about one quantum, which carries over to the next window, whichever
partition writes it. When a queue runs dry the others share its place. Quanta fill windows without gaps and are cut where
a window ends: only the last window is padded.

A quantum's place follows from the queues' totals alone: it is the number of tokens due before it, which has a closed
form. So nothing is sorted, no partition waits for another, and tokens are never shuffled: documents are tokenised once
into the shared folder, totals are added up per source and partition, and each partition then places its own pieces.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsidia.llm._common import slices, written
from obsidia.llm.bpe import words

_KEEP = 600_000
_BROADCAST_ROWS = 100_000


_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _by_ranks(path: str):
    """The same encoder by ranks, several times as fast on single words; None if the file can't be read as ranks.

    It can where a byte-level BPE has no normaliser and every merge makes the entry of the next id.
    """
    try:
        import tiktoken
    except ImportError:
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t.get("normalized") for t in spec["added_tokens"]):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if [vocabulary.get(m) for m in merges] != list(range(256, 256 + len(merges))) or len(vocabulary) != 256 + len(merges):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
    return tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)


class _Tokenizer:
    """Ids of texts as packed little-endian bytes; words between single spaces are remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.ranks = Tokenizer.from_file(path), _by_ranks(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        if self.ranks is None:
            return self._packed(words)
        code, encode = ("H" if self.kind == "<u2" else "I"), self.ranks.encode
        return [array(code, encode(w, allowed_special="all")).tobytes() for w in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as a single call of the library gives them."""
        if len(self.known) > _KEEP:
            self.known.clear()
        known = self.known
        parts = [words(t) for t in texts]
        new = set()
        for ps in parts:
            if ps:
                new.update(ps[1:])
        new = list(new.difference(known))
        known.update(zip(new, self._words([" " + p for p in new])))
        whole = iter(self._packed([t for t, ps in zip(texts, parts) if ps is None]))
        first = iter(self._words([ps[0] for ps in parts if ps]))
        out = [next(whole) if ps is None else next(first) + b"".join(map(known.__getitem__, ps[1:])) for ps in parts]
        for p in new:
            if len(p) > 64:
                del known[p]
        return out


@lru_cache(maxsize=2)
def _load(path: str) -> _Tokenizer:
    return _Tokenizer(path)


def _tokenise(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _load(path)
        kind, ending, part = tokenizer.kind, np.array([end], dtype=tokenizer.kind).tobytes(), TaskContext.get().partitionId()
        served: dict[str, int] = {}
        for batch in slices(batches, "text", 1 << 20):
            ids = [x + ending for x in tokenizer.encode(batch.column("text").to_pylist())]
            before, count = [], []
            for source, x in zip(batch.column("source").to_pylist(), ids):
                n = len(x) // np.dtype(kind).itemsize
                before.append(served.get(source, 0))
                count.append(n)
                served[source] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array([part] * batch.num_rows, pa.int32()), pa.array(before, pa.int64()), pa.array(count, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "part", "before", "n", "ids"],
            )

    return run


class Schedule:
    """Where each queue's tokens go: ``totals`` and whole ``weights`` by queue, and the tokens in a quantum."""

    def __init__(self, totals: list[int], weights: list[int], quantum: int):
        self.totals, self.weights, self.quantum = np.array(totals, dtype=np.int64), np.array(weights, dtype=np.int64), quantum

    def starts(self, queue: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Tokens that are due before the k-th quantum of each queue; ties are served in the order of queues."""
        out = np.zeros(len(k), dtype=np.int64)
        w = self.weights[queue]
        for other, (total, weight) in enumerate(zip(self.totals, self.weights)):
            due = (2 * k + 1) * weight
            earlier = np.where(other < queue, (due + w) // (2 * w), (due + w - 1) // (2 * w))
            out += np.where(other == queue, np.minimum(k * self.quantum, total), np.minimum(earlier * self.quantum, total))
        return out


def _place(schedule: Schedule, names: dict[str, int], window: int, kind: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = schedule.quantum
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            begin = batch.column("base").to_numpy() + batch.column("before").to_numpy()
            queue = np.array([names[s] for s in batch.column("source").to_pylist()])
            first, last = begin // q, (begin + n - 1) // q
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)
            pairs, at = np.unique(np.stack([queue[row], k]), axis=1, return_inverse=True)
            place = schedule.starts(pairs[0], pairs[1])[at.reshape(-1)] - k * q
            low, high = np.maximum(begin[row], k * q), np.minimum((begin + n)[row], (k + 1) * q)
            place += low
            # cut where a window ends; a quantum is no longer than a window
            room = np.minimum(high - low, window - place % window)
            over = high - low > room
            row = np.concatenate([row, row[over]])
            length = np.concatenate([room, (high - low - room)[over]])
            place = np.concatenate([place, (place + room)[over]])
            start = np.concatenate([low, (low + room)[over]]) - begin[row]
            order = np.lexsort((start, row))
            row, length, place, start = row[order], length[order], place[order], start[order]
            # neighbours within one window are one piece
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + length[:-1]) | (place[1:] % window == 0)
            heads = np.flatnonzero(new)
            length = np.add.reduceat(length, heads)
            row, place, start = row[heads], place[heads], start[heads]
            tokens = [np.frombuffer(x, dtype=kind).astype("<u4") for x in batch.column("ids").to_pylist()]
            cut = [tokens[r][a : a + m] for r, a, m in zip(row.tolist(), start.tolist(), length.tolist())]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()), pa.array(n[row]), pa.array(place // window), pa.array(place % window), batch.column("source").take(pa.array(row))]
            fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
            if with_ids:
                columns, fields = [*columns, pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))], [*fields, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    return run


def pack(df: DataFrame, path: str, window: int = 2048, quantum: int = 256, end: int = 1, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = False) -> DataFrame:
    """Pieces of documents placed in sequences: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    source``, and with ``with_ids`` each piece's ``ids array<int>``.

    ``targets``: the share of each source; sources without one, and all by default, get what they hold. Null texts are
    empty (the end id alone), a null source is the empty one; repeated rows and null ids are packed like any other; an
    empty table gives no pieces. The number of sources, which the driver and each task hold totals for, is a property
    of the mixture, not of the input's size.
    """
    quantum = min(quantum, window)
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"))
    kind = dict(texts.dtypes)["doc_id"]
    tokens = written(texts.mapInArrow(_tokenise(path, end), f"doc_id {kind}, source string, part int, before long, n long, ids binary"), compression="zstd")
    by_part = tokens.groupBy("source", "part").agg(F.sum("n").alias("total"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(by_part.select("source", "part", "total", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base")))
    totals = [(r["source"], int(r["total"])) for r in bases.groupBy("source").agg(F.sum("total").alias("total")).orderBy("source").collect()]
    whole = sum(t for _, t in totals)
    # products of quanta and weights stay within 63 bits: 30 bits of weight up to some 2**37 tokens, then fewer
    bits = min(30, 61 - (2 * (whole // quantum) + 3).bit_length())
    if bits < 10:
        raise ValueError("too many tokens for this quantum")
    weights = [max(1, round((targets or {}).get(s, t / max(whole, 1)) * (1 << bits))) for s, t in totals]
    schedule = Schedule([t for _, t in totals], weights, quantum)
    small = bases.select("source", "part", "base")
    if small.count() <= _BROADCAST_ROWS:
        small = F.broadcast(small)
    placed = tokens.join(small, ["source", "part"]).select("doc_id", "source", "before", "n", "base", "ids")
    ids = ", ids array<int>" if with_ids else ""
    item = _Tokenizer(path).kind
    return placed.mapInArrow(_place(schedule, {s: i for i, (s, _) in enumerate(totals)}, window, item, with_ids), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string{ids}")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``: sequences of 2048 tokens, end id 1."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
