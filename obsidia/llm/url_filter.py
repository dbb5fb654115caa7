"""URL rules as one bit-parallel wildcard automaton.

A rule is a host and a path; it fits its host and all subdomains where the URL's path starts with the rule's. Each rule
becomes the globs ``host path*`` and ``*.host path*`` (``*`` in the host never crosses a ``/``; ``?`` stands for any
one byte). All globs are laid end to end in a Shift-And automaton of as many 64-bit words as they need; every byte of
the canonical URL (lower-cased host, then path) advances all globs of all URLs of a batch at once. The longest rule
that fits gives the verdict; of equally long ones the first listed; without any, the default.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm._common import utf8

_ONE = np.uint64(1)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CELLS = 1 << 22


class Rule(NamedTuple):
    """``path`` starts with ``/``."""

    host: str
    path: str
    verdict: str


class Automaton:
    """All rules' globs in packed masks; symbol 256 is the end of a URL and leaves states as they are."""

    def __init__(self, rules: Sequence[Rule]):
        globs = [(k, sub, f"{'.' if sub else ''}{r.host}{r.path}".encode()) for k, r in enumerate(rules) for sub in (False, True)]
        bits = sum(len(g) + 1 for _, _, g in globs)
        self.words = max(1, -(-bits // 64))
        self.step = np.zeros((257, self.words), dtype=np.uint64)
        self.stay = np.zeros((257, self.words), dtype=np.uint64)
        self.first = np.zeros(self.words, dtype=np.uint64)
        self.final = np.zeros((len(rules), self.words), dtype=np.uint64)
        self.stay[256] = ~np.uint64(0)
        at = 0
        for k, sub, glob in globs:
            word, bit = at >> 6, _ONE << np.uint64(at & 63)
            self.first[word] |= bit
            if sub:
                self.stay[np.arange(257) != ord("/"), word] |= bit
            for i, symbol in enumerate(glob, 1):
                place = at + i
                self.step[slice(0, 256) if symbol == ord("?") else symbol, place >> 6] |= _ONE << np.uint64(place & 63)
            at += len(glob)
            self.final[k, at >> 6] |= _ONE << np.uint64(at & 63)
            self.stay[:, at >> 6] |= _ONE << np.uint64(at & 63)
            at += 1

    def run(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Which rules (columns) fit which URLs (rows), for URLs laid end to end."""
        out = np.zeros((len(lengths), len(self.final)), dtype=bool)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j - i + 1) * (lengths[order[j]] + 1) <= _CELLS:
                j += 1
            rows = order[i:j]
            out[rows] = self._block(data, starts[rows], lengths[rows])
            i = j
        return out

    def _block(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        states = np.tile(self.first, (len(starts), 1))
        for t in range(int(lengths.max())):
            alive = t < lengths
            symbol = np.where(alive, data[np.minimum(starts + t, len(data) - 1)], 256)
            moved = states << _ONE
            moved[:, 1:] |= states[:, :-1] >> np.uint64(63)
            states = (moved & self.step[symbol]) | (states & self.stay[symbol])
        return ((states[:, None, :] & self.final[None]) != 0).any(axis=2)


def _judge(rules: Sequence[Rule], default: str):
    automaton = Automaton(rules)
    names = [r.host + r.path for r in rules]
    rank = sorted(range(len(rules)), key=lambda k: -len(names[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, lengths = utf8(batch.column("canonical"))
            fits = automaton.run(data, lengths)
            best = np.full(len(lengths), -1)
            for k in reversed(rank):
                best[fits[:, k]] = k
            chosen = [None if k < 0 else names[k] for k in best.tolist()]
            verdict = [default if k < 0 else rules[k].verdict for k in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("page_id", "host", "path")] + [pa.array(chosen, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judge(df: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per input row, without a shuffle.

    Null or empty URLs and those without ``://`` have an empty host and path and get the default verdict; repeated rows
    and null ids keep their rows; other columns are ignored.
    """
    pattern = r"(?s)^(?:(?!://).)*://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER)
    parts = df.select(F.col(id_col).alias("page_id"), host.alias("host"), F.regexp_extract(url, pattern, 2).alias("path"))
    kind = dict(parts.dtypes)["page_id"]
    return parts.withColumn("canonical", F.concat("host", "path")).mapInArrow(_judge(tuple(rules), default), f"page_id {kind}, host string, path string, rule string, verdict string")


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract query over all of ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


OP7_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT parts.page_id, h || p AS rule, v, row_number() OVER (PARTITION BY parts.page_id ORDER BY length(h || p) DESC) AS k
  FROM parts JOIN rules ON (parts.host = h OR ends_with(parts.host, '.' || h)) AND starts_with(parts.path, p)
)
SELECT parts.page_id, parts.host, parts.path, fits.rule, coalesce(fits.v, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND k = 1
"""
