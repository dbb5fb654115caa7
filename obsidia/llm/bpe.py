"""Byte-level BPE by backtracking over longest matches, in time linear in the text.

Vocabulary entries are mapped byte by byte to Latin-1 so that pyahocorasick can find, in one pass, the longest entry
that starts at each byte. Encoding takes the longest entry whose adjacency to its predecessor is *compatible*: merging
the two on their own would not move the border between them. Where no entry fits, the last one is taken back and its
next shorter prefix entry tried. Borders from which the rest was found impossible are remembered, so none is tried twice.
The outcome is what applying merges by rank would give.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from obsidia.llm._common import keyed, slices


class Encoder:
    """Encoder and decoder of one rank file; ``pattern`` splits texts into the pieces that merges stay within."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 400_000):
        import ahocorasick

        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self._find = regex.compile(pattern).findall
        self._match = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._match.add_word(token.decode("latin-1"), rank)
        self._match.make_automaton()
        self._shorter = [self._prefix_entry(t) for t in self.tokens]
        self._compatible: dict[tuple[int, int], bool] = {}
        self._joined: dict[tuple[int, int], int] = {}
        self._halves: list[tuple[int, int]] = []
        self._learn_merges()
        self._keep = keep
        self._pieces: dict[str, list[int]] = {}
        self._chunks = _Chunks(self, keep)

    def _prefix_entry(self, token: bytes) -> int:
        return next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), -1)

    def _learn_merges(self) -> None:
        """Which two entries each entry was merged from: the one split whose halves are compatible below its rank."""
        for rank, token in enumerate(self.tokens):
            halves = (rank, rank)
            left = self._shorter[rank]
            while left >= 0:
                right = self.ranks.get(token[len(self.tokens[left]) :], rank)
                if left < rank and right < rank and self._adjacent(left, right):
                    self._joined[left, right] = rank
                    halves = (left, right)
                    break
                left = self._shorter[left]
            self._halves.append(halves)

    def _adjacent(self, left: int, right: int) -> bool:
        """Undo merges of both sides, latest first, and see if an earlier merge would have crossed the border."""
        below = len(self.tokens)
        while True:
            crossing = self._joined.get((left, right))
            if crossing is not None and crossing < below:
                return False
            if left > right and self._halves[left][1] != left:
                below, left = left, self._halves[left][1]
            elif self._halves[right][0] != right:
                below, right = right + 1, self._halves[right][0]
            elif self._halves[left][1] != left:
                below, left = left, self._halves[left][1]
            else:
                return True

    def _fits(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._compatible.get(key)
        if known is None:
            if len(self._compatible) > 4 * self._keep:
                self._compatible.clear()
            known = self._compatible[key] = self._adjacent(left, right)
        return known

    def encode_piece(self, raw: bytes) -> list[int]:
        """Entries of one piece."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        tokens, shorter = self.tokens, self._shorter
        longest = [-1] * (len(raw) + 1)
        size = [0] * len(raw)
        for end, rank in self._match.iter(raw.decode("latin-1")):
            n = len(tokens[rank])
            at = end + 1 - n
            if n > size[at]:
                size[at], longest[at] = n, rank
        dead = bytearray(len(raw) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(raw):
            while token >= 0:
                end = at + len(tokens[token])
                if not dead[end] and (not out or self._fits(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, token = end, longest[end]
            else:
                dead[at] = 1
                token = out.pop()
                at -= len(tokens[token])
        return out

    def encode(self, text: str) -> list[int]:
        """Entries of a whole text, special tokens being ordinary text."""
        out: list[int] = []
        for piece in self._find(text):
            known = self._pieces.get(piece)
            if known is None:
                known = self.encode_piece(piece.encode())
                if len(piece) <= 64:
                    if len(self._pieces) >= self._keep:
                        self._pieces.clear()
                    self._pieces[piece] = known
            out += known
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes that entries stand for."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of entries, SHA-256 of their decimal ids joined by spaces, and SHA-256 of the decoded bytes."""
        parts = chunks(text)
        if parts is None:
            ids = self.encode(text)
            return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()
        known = self._chunks.values_of(parts)
        return sum([k[0] for k in known]), hashlib.sha256(" ".join([k[1] for k in known]).encode()).hexdigest(), hashlib.sha256(b"".join([k[2] for k in known])).hexdigest()


def words(text: str) -> list[str] | None:
    """The text cut at every single space between other characters, before which the pattern always cuts too.

    None if white space meets such a space, for then the pattern's look-ahead reaches across it, or the text is empty.
    """
    parts = text.split(" ")
    return parts if all(parts) and list(map(str.strip, parts)) == parts else None


def chunks(text: str) -> list[str] | None:
    """``words`` with their spaces before them."""
    parts = words(text)
    return parts and [parts[0], *[" " + p for p in parts[1:]]]


class _Chunks(dict):
    """What encoding gives for text between single spaces; the least costly memory of repeated words."""

    def __init__(self, encoder: Encoder, keep: int):
        super().__init__()
        self.encoder, self.keep = encoder, keep

    def __missing__(self, chunk: str) -> tuple[int, str, bytes]:
        ids = self.encoder.encode(chunk)
        value = (len(ids), " ".join(map(str, ids)), self.encoder.decode(ids))
        if len(chunk) <= 64:
            self[chunk] = value
        return value

    def values_of(self, parts: list[str]) -> list[tuple[int, str, bytes]]:
        if len(self) >= self.keep:
            self.clear()
        return [self[p] for p in parts]


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Encoder:
    """Encoder of a rank file; one per worker process."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def encode_documents(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id, text_key`` and the encoded text: ``ids array<int>, decoded binary``.

    With ``digests``, ``n_tokens, ids_sha256, decoded_sha256`` in their place, which spares moving the ids. Null texts
    are empty: no ids. One row per input row, repeated rows and null ids included; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path, pattern)
        for batch in slices(batches, "text", 1 << 22):
            texts = batch.column("text").to_pylist()
            if digests:
                n, ids, raw = zip(*map(encoder.digest, texts)) if texts else ((), (), ())
                columns, names = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                each = [encoder.encode(t) for t in texts]
                columns, names = [pa.array(each, pa.list_(pa.int32())), pa.array([encoder.decode(x) for x in each], pa.binary())], ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *columns], names=["doc_id", "text_key", *names])

    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return keyed(df, id_col, text_col).mapInArrow(run, f"doc_id long, text_key long, {kinds}")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents`` with the 50k rank file."""
    import public_tokenizers

    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return out.drop("text_key")
