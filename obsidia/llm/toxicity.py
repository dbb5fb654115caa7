"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms. Its score adds a bias, a weight per term and, for every pair of terms, the
dot product of their factors, so that pairs such as an insult beside a group's name count beyond what the terms add
up to. Terms are lower-cased (ASCII) runs of letters, digits and non-ASCII bytes of the whole text.

Fitting uses at most ``sample`` labelled documents, those with the least hashed ids; nothing else is bounded. Their
terms are counted and screened on the executors: the driver gets two numbers a hashed term, and of the documents only
the terms that the model knows. Scoring reads every document once, without a shuffle, and broadcasts the model, whose size ``2**bits`` fixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm import _words
from obsidia.llm._common import discard, keyed, ranges, slices, utf8, written

_TERM = np.full(256, 0x20, dtype=np.uint8)
_TERM[0x80:] = np.arange(0x80, 256)
_TERM[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
for _a in range(26):
    _TERM[ord("A") + _a] = _TERM[ord("a") + _a] = ord("a") + _a


#: Bytes of a word that are a stem.
_STEMS = (6, 7)
_SHARED = 0x2545F491
_APART = 2.5


class Model(NamedTuple):
    """``known``: 1 + row of a hashed term in ``weights`` and ``factors``, 0 for terms that carry nothing."""

    bits: int
    bias: float
    known: np.ndarray
    weights: np.ndarray
    factors: np.ndarray


def _terms(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents' distinct hashed terms: document index and term, sorted by both."""
    data, lengths = utf8(column)
    words = _words.split(_TERM[data], lengths)
    short = lambda h: (h >> np.uint64(64 - bits)).astype(np.int64)
    term, mask = short(words.hashes()), (1 << bits) - 1
    doc = np.repeat(np.arange(len(lengths)), words.per_doc)
    found = [(doc << bits) | term]
    for at, hashes in words.prefixes(_STEMS):
        # a stem is a term, and another one where words of the document share it
        stems, n = np.unique(np.unique((((doc[at] << bits) | short(hashes)) << bits) | term[at]) >> bits, return_counts=True)
        found += [stems, (several := stems[n > 1]) & ~mask | (several * _SHARED & mask)]
    both = np.unique(np.concatenate(found))
    return both >> bits, both & mask


def _margins(doc: np.ndarray, row: np.ndarray, n: int, bias: float, weights: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of n documents from (document, model row) pairs, and each document's summed factors."""
    out = np.full(n, bias, dtype=np.float64)
    out += np.bincount(doc, weights[row], n)
    sums = np.empty((n, factors.shape[1]))
    for k in range(factors.shape[1]):
        f = factors[row, k]
        sums[:, k] = np.bincount(doc, f, n)
        out += 0.5 * (sums[:, k] ** 2 - np.bincount(doc, f * f, n))
    return out, sums


def _prior(n: int, positive: float) -> float:
    """Share of label 1 among n documents; 0.1 without any."""
    return (positive + 0.5) / (n + 1) if n else 0.1


def screen(seen: np.ndarray, positive: np.ndarray, n: int, total: float, least: int | None = None) -> np.ndarray:
    """``known`` of a model, from each hashed term's documents and their sum of labels, and both of all documents.

    Terms of fewer than ``least`` documents are left out: by default one in 400, and 3. So are those whose share of
    label 1 lies within ``_APART`` standard errors of that of all documents.
    """
    least = max(3, n // 400) if least is None else least
    prior = _prior(n, total)
    apart = positive - seen * prior
    chosen = np.flatnonzero((seen >= least) & (apart**2 >= _APART**2 * seen * prior * (1 - prior)))
    known = np.zeros(len(seen), dtype=np.int32)
    known[chosen] = np.arange(1, len(chosen) + 1)
    return known


def fit(doc: np.ndarray, row: np.ndarray, label: np.ndarray, known: np.ndarray, bits: int, rank: int = 4, epochs: int = 15, rate: float = 0.2, seed: int = 7) -> Model:
    """Fit on documents' rows of known terms by Adagrad on the logistic loss, with the linear weights soft-thresholded."""
    n, m = len(label), int(known.max(initial=0))
    prior = _prior(n, label.sum())
    rng = np.random.default_rng(seed)
    weights, factors = np.zeros(m), rng.normal(0, 0.01, (m, rank))
    bias = float(np.log(prior / (1 - prior)))
    w2, f2, b2 = np.full(m, 1e-2), np.full((m, rank), 1e-2), 1e-2
    begin = np.searchsorted(doc, np.arange(n + 1))
    l1, l2 = 1e-4, 1e-5
    for _ in range(epochs if m and n else 0):
        order = rng.permutation(n)
        for i in range(0, n, 256):
            picked = order[i : i + 256]
            counts = begin[picked + 1] - begin[picked]
            at = np.repeat(begin[picked] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            d, r = np.repeat(np.arange(len(picked)), counts), row[at]
            margin, sums = _margins(d, r, len(picked), bias, weights, factors)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[picked]) / len(picked)
            rows, place = np.unique(r, return_inverse=True)
            gw = np.bincount(place, error[d], len(rows)) + l2 * weights[rows]
            w2[rows] += gw * gw
            pace = rate / np.sqrt(w2[rows])
            moved = weights[rows] - pace * gw
            weights[rows] = np.sign(moved) * np.maximum(np.abs(moved) - pace * l1, 0)
            for k in range(rank):
                gf = np.bincount(place, error[d] * (sums[d, k] - factors[r, k]), len(rows)) + l2 * factors[rows, k]
                f2[rows, k] += gf * gf
                factors[rows, k] -= 0.25 * rate * gf / np.sqrt(f2[rows, k])
            g = float(error.sum())
            b2 += g * g
            bias -= rate * g / np.sqrt(b2)
    return Model(bits, bias, known, weights.astype(np.float32), factors.astype(np.float32))


def train(df: DataFrame, labels: DataFrame, sample: int = 16000, bits: int = 18, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Model:
    """Fit on the documents of labelled ids; of several labels of one id the greatest counts, null ones do not.

    Only the counts of hashed terms reach the driver, and the known ones of at most ``sample`` documents. Without any
    labelled document the model gives every text the same low score.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("id")).agg(F.max(F.col(label_col)).cast("double").alias("label"))
    picked = marked.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = keyed(df, id_col, text_col).join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            doc, term = _terms(batch.column("text"), bits)
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            each = [term[a:b].astype(np.int32).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(each, pa.binary())], names=["id", "label", "terms"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, positive, n, total = np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits), 0, 0.0
        for batch in slices(batches, "terms", 1 << 20):
            (data, lengths), label = utf8(batch.column("terms")), batch.column("label").to_numpy()
            term = data.view(np.int32)
            seen += np.bincount(term, minlength=1 << bits)
            positive += np.bincount(term, np.repeat(label, lengths // 4), 1 << bits)
            n, total = n + len(label), total + float(label.sum())
        term = np.flatnonzero(seen)
        columns = np.append(term, -1).astype(np.int32), np.append(seen[term], n), np.append(positive[term], total)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["term", "seen", "positive"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "terms", 1 << 20):
            data, lengths = utf8(batch.column("terms"))
            row = shared.value[data.view(np.int32)]
            bounds = np.append(0, np.cumsum(row > 0))[np.append(0, np.cumsum(lengths // 4))].tolist()
            row = row[row > 0] - 1
            each = [row[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(each, pa.binary())], names=["id", "label", "rows"])

    # rows that repeat an id count once
    once = texts.mapInArrow(run, "id long, label double, terms binary").groupBy("id").agg(F.min_by(F.struct("label", "terms"), "terms").alias("x"))
    rows = written(once.select("id", "x.label", "x.terms"), compression="zstd")
    # the number of documents and their sum of labels stand at term -1
    counts = rows.mapInArrow(count, "term int, seen long, positive double").groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("positive").alias("positive")).toArrow()
    term = counts.column("term").to_numpy()
    seen, positive = np.zeros(1 + (1 << bits), dtype=np.int64), np.zeros(1 + (1 << bits))
    seen[term], positive[term] = counts.column("seen").to_numpy(), counts.column("positive").to_numpy()
    known = screen(seen[:-1], positive[:-1], int(seen[-1]), float(positive[-1]))

    shared = df.sparkSession.sparkContext.broadcast(known)
    found = rows.mapInArrow(pick, "id long, label double, rows binary").toArrow()
    discard(rows)
    data, lengths = utf8(found.column("rows"))
    order, each = np.argsort(found.column("id").to_numpy()), lengths // 4
    row = data.view(np.int32)[ranges((np.cumsum(each) - each)[order], each[order])]
    return fit(np.repeat(np.arange(len(each)), each[order]), row, found.column("label").to_numpy()[order], known, bits)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """Probability of each text in a column."""
    doc, term = _terms(column, model.bits)
    row = model.known[term]
    doc, row = doc[row > 0], row[row > 0] - 1
    margin, _ = _margins(doc, row, len(column), model.bias, model.weights, model.factors)
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``toxicity double`` (0 to 1); null texts are scored as empty ones.

    A column of that name in ``df`` is replaced. The text is the only input of the score.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c.lower() != "toxicity"]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), text_col, 1 << 18):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(part.column(at), shared.value))], names=[*kept, "toxicity"])

    kinds = df.select(*kept).schema.add("toxicity", "double")
    return df.select(*kept).mapInArrow(run, kinds)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``; labels of the held-out fifth are never read by the fit."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(docs, labels.where(~held_out))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
