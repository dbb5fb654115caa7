"""Exact top-k search by a bit-sliced index.

Components are quantised to integers. A block of candidates keeps, for each component and each binary digit, a bitmap
over its rows (negative numbers by an offset). A query's scores are a weighted sum of components: the weights' signed
digits select shifted slices (complemented for negative digits), and full adders over whole bitmaps add them up, column
by column, to the bitmaps of the sum's digits. From its most significant slice downward, rows are split into those
surely among the best k, those tied so far and the rest; rows still tied at the last slice have equal scores and are
resolved by id. No score is computed row by row except the reported ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ROWS = 16384
_ALL = ~np.uint64(0)


def signed_digits(weight: int) -> list[tuple[int, bool]]:
    """(place, is negative) of a weight's nonzero digits, no two of them adjacent."""
    out, place = [], 0
    while weight:
        if weight & 1:
            digit = 2 - (weight & 3)
            out.append((place, digit < 0))
            weight -= digit
        weight >>= 1
        place += 1
    return out


class Block:
    """Slices of up to ``_ROWS`` rows, sorted by id so that the first set bit is the least id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, digits: int):
        self.ids, self.values, self.digits = ids, values, digits
        self.words = -(-len(ids) // 64)
        lifted = np.zeros((self.words * 64, values.shape[1]), dtype=np.int64)
        lifted[: len(ids)] = values + (1 << (digits - 1))
        bits = (lifted.T[:, None, :] >> np.arange(digits)[None, :, None]) & 1
        self.slices = np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view(np.uint64)
        self.rows = np.packbits(np.arange(self.words * 64) < len(ids), bitorder="little").view(np.uint64)

    def sum_slices(self, weights: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the digits of each row's weighted sum, up to a constant, least significant first."""
        component, place, flip = [], [], []
        for d, w in enumerate(weights.tolist()):
            for p, negative in signed_digits(w):
                component.append(d), place.append(p), flip.append(negative)
        if not component:
            return []
        component, place = np.array(component), np.array(place)
        mask = np.where(np.array(flip), _ALL, np.uint64(0))[:, None]
        columns: dict[int, list[np.ndarray]] = {}
        for j in range(self.digits):
            for p in np.unique(place).tolist():
                at = place == p
                columns.setdefault(p + j, []).append(self.slices[component[at], j] ^ mask[at])
        out, p = [], 0
        while columns:
            stack = columns.pop(p, None)
            if stack is None:
                out.append(np.zeros(self.words, dtype=np.uint64))
            else:
                column = np.concatenate(stack) if len(stack) > 1 else stack[0]
                while len(column) > 1:
                    third = len(column) // 3
                    if third:
                        a, b, c = column[:third], column[third : 2 * third], column[2 * third : 3 * third]
                        half = a ^ b
                        columns.setdefault(p + 1, []).append((a & b) | (c & half))
                        column = np.concatenate([half ^ c, column[3 * third :]])
                    else:
                        a, b = column[:1], column[1:]
                        columns.setdefault(p + 1, []).append(a & b)
                        column = a ^ b
                out.append(column[0])
            p += 1
        return out

    def top(self, query_id: int, weights: np.ndarray, k: int, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (of type ``kind``) of the k best rows but the query's own, ties to smaller ids, in no order."""
        tied = self.rows.copy()
        own = np.searchsorted(self.ids, query_id)
        if own < len(self.ids) and self.ids[own] == query_id:
            tied[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        sure = np.zeros_like(tied)
        for digit in reversed(self.sum_slices(weights)):
            ahead = sure | (tied & digit)
            n = int(np.bitwise_count(ahead).sum())
            if n > k:
                tied &= digit
            else:
                sure = ahead
                tied &= ~digit
                if n == k:
                    tied[:] = 0
                    break
        picked = self._set(sure)
        picked = np.concatenate([picked, self._set(tied)[: k - len(picked)]])
        return self.ids[picked], self.values[picked].astype(kind) @ weights.astype(kind)

    def _set(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _search(k: int, digits: int, wide: int, kind: type):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            (cid, cv), (qid, qv) = (_rows(t, wide) for t in (left, right))
            for at in range(0, len(cid), _ROWS):
                block = Block(cid[at : at + _ROWS], cv[at : at + _ROWS], digits)
                for q, weights in zip(qid.tolist(), qv):
                    ids, scores = block.top(q, weights, k, kind)
                    for o, v in zip(out, (np.full(len(ids), q), ids, scores)):
                        o.append(v)
        arrays = [pa.array(np.concatenate(o) if o else np.zeros(0, dtype=np.int64), pa.int64()) for o in out[:2]]
        scores = np.concatenate(out[2]) if out[2] else np.zeros(0, dtype=np.int64)
        arrays.append(pa.array(scores, pa.int64()) if kind is np.int64 else pa.array([Decimal(int(x)) for x in scores], pa.decimal128(38, 0)))
        return pa.Table.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    return run


def _rows(table: pa.Table, wide: int) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    values = np.zeros((len(ids), wide), dtype=np.int64)
    for row, x in zip(values, table.column("q").to_pylist()):
        row[: len(x)] = x
    order = np.argsort(ids, kind="stable")
    return ids[order], values[order]


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", rows: int = 65536, queries_at_once: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each vector of ``queries`` the k rows of ``df`` with the greatest inner
    product of components ``floor(scale * x)``, without the row of its own id; ties go to smaller ids.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Rows that repeat
    an id count once, with the least vector. Missing last components count as zero. Quantised components may have 53
    binary digits, which doubles hold exactly; more is an error. Ranks are exact whatever the scores; one that doesn't
    fit a long is reported as null. Other columns are ignored.

    Queries meet all rows block by block; the grid of ``rows`` by ``queries_at_once`` bounds a task's memory.
    """

    def quantised(frame: DataFrame) -> DataFrame:
        x = F.col(vec_col).cast("array<double>")
        good = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
        q = F.transform(x, lambda v: F.floor(v * F.lit(scale)).cast("long"))
        return frame.where(good).select(F.col(id_col).cast("long").alias("id"), q.alias("q")).groupBy("id").agg(F.min("q").alias("q"))

    rows_q, queries_q = quantised(df), quantised(queries)
    size = lambda c: F.greatest(F.abs(F.coalesce(F.array_max(c), F.lit(0))), F.abs(F.coalesce(F.array_min(c), F.lit(0))))
    n, most, wide = rows_q.agg(F.count("*"), F.max(size("q")), F.max(F.size("q"))).first()
    n_q, most_q, wide_q = queries_q.agg(F.count("*"), F.max(size("q")), F.max(F.size("q"))).first()
    digits = int(most or 0).bit_length() + 1
    if max(int(most or 0), int(most_q or 0)) >= 1 << 53:
        raise ValueError("quantised components need more than 53 binary digits")
    long = int(most or 0) * int(most_q or 0) * max(wide or 0, wide_q or 0) < 1 << 63
    blocks, parts = max(1, math.ceil(n / rows)), max(1, math.ceil(n_q / queries_at_once))
    left = rows_q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries_q.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    best = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_search(k, digits, max(wide or 0, wide_q or 0), np.int64 if long else object), f"query_id long, vec_id long, score {'long' if long else 'decimal(38,0)'}")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.expr("try_cast(score as bigint)").alias("score"))


def op2_bit_sliced(spark, sf_dir: str) -> DataFrame:
    """Contract query: every fiftieth row of ``embeddings`` against all rows."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    # many smaller blocks keep all executors busy on one query part
    return top_k(df, df.where("vec_id % 50 = 0"), rows=16384, queries_at_once=512)


OP2_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""
