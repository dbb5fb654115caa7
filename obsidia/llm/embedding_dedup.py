"""Embedding near-dedup by NN-descent.

1. Equal vectors become one node with a count, an id of its own and the least ``vec_id`` as label. Nodes are normalised; the search carries one signed byte per component,
   links are tested on the original components in double precision.
2. The first graph comes from a few random orders: nodes are range-partitioned and sorted by the signs of random
   projections, and each meets the ones next to it.
3. Every round joins, at each node, its neighbours with one another (those new to a list with all), and each node keeps
   its ``k`` best. Rounds end when hardly any list changes.
4. Every edge met on the way that may reach the threshold is tested and kept before lists are cut; they give components.
5. A list that is full of links is saturated: its node may have more of them than ``k``, also in other components. So
   components meet without lists: nodes with the same signs in one of several random tables are compared with all
   others there that lie in another component. Tables are as many as a link at the threshold needs to share one.
6. Members of a component meet in blocks of ``block`` by ``block`` and links are counted exactly, none is listed.
7. An audit compares nodes with all nodes: ``audit`` of them, and more until 300 have links or the sample is as large as
   it may get. While less than 99 in 100 of a linked node's links lie inside its component on average, random orders
   and tables are added and rounds go on. If ``attempts`` of that don't reach it, an error tells the recall.

Only the audited vectors are broadcast: 16,384 and about two million numbers at most.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsidia.llm._common import discard, written
from obsidia.llm._components import components

_LOG = logging.getLogger(__name__)
_RECALL = 0.99
_SCALE = 127.0
_SLACK = 0.02
_NEAR = 3
#: Probability that a link just at the threshold shares no table; closer ones are missed far less.
_MISS = 1e-5
#: Linked nodes that an audit wants; nodes and numbers it takes at most.
_LINKED, _AUDIT_MOST, _AUDIT_VALUES = 300, 16_384, 1 << 21


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """Lists of one batch as rows; shorter ones end in zeros."""
    lists = column.to_pylist()
    out = np.zeros((len(lists), max(map(len, lists), default=0)), dtype=dtype)
    for row, x in zip(out, lists):
        row[: len(x)] = x
    return out


def _codes(raw: list[bytes]) -> np.ndarray:
    wide = max(map(len, raw), default=0)
    if all(len(r) == wide for r in raw):
        return np.frombuffer(b"".join(raw), dtype=np.int8).reshape(len(raw), wide).astype(np.float32) / _SCALE
    return np.stack([np.frombuffer(r.ljust(wide, b"\0"), dtype=np.int8) for r in raw]).astype(np.float32) / _SCALE


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("embedding"))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in np.round(x * _SCALE).astype(np.int8)], pa.binary())], names=["id", "code"])


def _order_keys(seeds: list[int]):
    """For each random order, a sortable code of projection signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            raw = batch.column("code").to_pylist()
            x = _codes(raw)
            for seed in seeds:
                p = planes.setdefault((seed, x.shape[1]), np.random.default_rng(seed).normal(size=(x.shape[1], 32)).astype(np.float32))
                key = ((x @ p > 0).astype(np.int64) << np.arange(32)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), seed)), pa.array(key), batch.column("id"), batch.column("code")], names=["seed", "key", "id", "code"])

    return run


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Similarity of rows at most ``_NEAR`` places apart in one order."""
    seeds, ids, raw = [], [], []
    for batch in batches:
        seeds, ids, raw = seeds[-_NEAR:] + batch.column("seed").to_pylist(), ids[-_NEAR:] + batch.column("id").to_pylist(), raw[-_NEAR:] + batch.column("code").to_pylist()
        x, i, s = _codes(raw), np.array(ids), np.array(seeds)
        out = [[], [], []]
        for d in range(1, min(_NEAR, len(ids) - 1) + 1):
            same = s[:-d] == s[d:]
            sim = np.einsum("ij,ij->i", x[:-d], x[d:])[same]
            for o, v in zip(out, (i[:-d][same], i[d:][same], sim)):
                o.append(v)
        if out[0]:
            yield _edges(*map(np.concatenate, out))


def _edges(a: np.ndarray, b: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(sim.astype(np.float32))], names=["u", "v", "sim"])


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At each node, pairs of its neighbours (one of them new) that would enter the list of either."""
    at, held = None, []

    def solve() -> pa.RecordBatch | None:
        if len(held) < 2:
            return None
        ids, new, floor = np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.array([h[2] for h in held])
        x = _codes([h[3] for h in held])
        sim = x @ x.T
        want = (sim > np.minimum(floor[:, None], floor[None])) & (new[:, None] | new[None]) & (ids[:, None] < ids[None])
        a, b = np.nonzero(want)
        return _edges(ids[a], ids[b], sim[a, b]) if len(a) else None

    for batch in batches:
        found = []
        for p, *rest in zip(*(batch.column(c).to_pylist() for c in ("p", "id", "new", "floor", "code"))):
            if p != at:
                if (one := solve()) is not None:
                    found.append(one)
                at, held = p, []
            held.append(rest)
        if found:
            yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]
    if (one := solve()) is not None:
        yield one


def _tables(total: int, threshold: float) -> tuple[int, int]:
    """Signs a table and number of tables, so that all but ``_MISS`` of links share one, at the least cost."""
    same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi

    def tables(bits: int) -> float:
        p = same**bits
        return 1 if p >= 1 else math.ceil(math.log(_MISS) / math.log1p(-p)) if p > 1e-9 else math.inf

    # a row costs about as much to move as to compare with 2048 others
    bits = min(range(31), key=lambda b: tables(b) * (1 + total / 2**b / 2048))
    return bits, int(tables(bits))


def _bucket_keys(seeds: list[int], bits: int):
    """Each node once a table, with the bucket of its projection signs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = _codes(batch.column("code").to_pylist())
            for seed in seeds:
                p = planes.setdefault((seed, x.shape[1]), np.random.default_rng([7, seed]).normal(size=(x.shape[1], bits)).astype(np.float32))
                signs = ((x @ p > 0).astype(np.int64) << np.arange(bits)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array((seed << bits) + signs), *(batch.column(c) for c in ("label", "id", "code"))], names=["bucket", "label", "id", "code"])

    return run


def _across(threshold: float):
    """Pairs of each bucket, of different labels, that may be linked; of those that surely are, one for two labels."""

    def solve(labels: np.ndarray, ids: np.ndarray, raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, group, size = np.unique(labels, return_inverse=True, return_counts=True)
        if len(size) < 2:
            return
        # of two labels one isn't the largest group's, which comes last and isn't compared with itself
        order = np.argsort(group == size.argmax(), kind="stable")
        group, ids, x = group[order], ids[order], _codes(raw)[order]
        for s in range(0, len(ids) - int(size.max()), 128):
            rows = np.arange(s, min(s + 128, len(ids) - int(size.max())))
            sim = x[rows] @ x[s:].T
            a, b = np.nonzero(sim >= threshold - _SLACK)
            fit = (group[rows[a]] != group[s + b]) & (a < b)
            a, b = a[fit], b[fit]
            if len(a):
                two = np.minimum(group[rows[a]], group[s + b]) * len(size) + np.maximum(group[rows[a]], group[s + b])
                sure = np.flatnonzero(sim[a, b] >= threshold + _SLACK)
                one = sure[np.unique(two[sure], return_index=True)[1]]
                keep = np.concatenate([one, np.flatnonzero(~np.isin(two, two[one]))])
                yield _edges(ids[rows[a[keep]]], ids[s + b[keep]], sim[a[keep], b[keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for begin, end in zip(cuts, cuts[1:]):
                if held and held[-1].column("bucket")[0].as_py() != buckets[begin]:
                    yield from finish(held)
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from finish(held)

    def finish(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        yield from solve(t.column("label").to_numpy(), t.column("id").to_numpy(), t.column("code").to_pylist())

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k most similar neighbours; a pair counts once, as old if it was known before."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "new"))
    once = both.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    by = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    return once.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _round(lists: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """New candidates from the neighbours of neighbours, one way per pair."""
    floor = lists.groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(-2.0).cast("float").alias("floor"))
    known = codes.join(floor, F.col("id") == F.col("u"), "left").select("id", "code", F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor"))
    # neighbours on both sides; of those that name a node, its k most similar
    back = lists.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.col("sim").desc(), "u"))).where(F.col("r") <= k)
    around = lists.select(F.col("u").alias("p"), F.col("v").alias("id"), "new").unionByName(back.select(F.col("v").alias("p"), F.col("u").alias("id"), "new"))
    near = around.groupBy("p", "id").agg(F.max("new").alias("new")).join(known, "id")
    return near.select("p", "id", "new", "floor", "code").repartition("p").sortWithinPartitions("p", "id").mapInArrow(_local_join, "u long, v long, sim float")


def _tested(edges: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges whose cosine in double precision reaches the threshold, as ``u, v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _matrix(batch.column("a")), _matrix(batch.column("b"))
            w = max(a.shape[1], b.shape[1])
            a, b = np.pad(a, ((0, 0), (0, w - a.shape[1]))), np.pad(b, ((0, 0), (0, w - b.shape[1])))
            cos = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            keep = pa.array(cos >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], names=["u", "v"])

    a = nodes.select(F.col("id").alias("u"), F.col("embedding").alias("a"))
    b = nodes.select(F.col("id").alias("v"), F.col("embedding").alias("b"))
    return edges.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _count_links(threshold: float):
    """Weighted links of each node to the others of its group; rows with ``side`` are counted against the rest only."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        ids, weight, side = (np.array([h[k] for h in held], dtype=np.int64) for k in range(3))
        w = max(len(h[3]) for h in held)
        x = np.zeros((len(held), w))
        for row, h in zip(x, held):
            row[: len(h[3])] = h[3]
        norm = np.linalg.norm(x, axis=1)
        if (side < 0).all():
            linked = x @ x.T / np.outer(norm, norm) >= threshold
            np.fill_diagonal(linked, False)
            return _counts(ids, linked @ weight)
        first = side == side.min()
        linked = x[first] @ x[~first].T / np.outer(norm[first], norm[~first]) >= threshold
        return _counts(np.concatenate([ids[first], ids[~first]]), np.concatenate([linked @ weight[~first], linked.T @ weight[first]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            found = []
            for *key, i, n, side, x in zip(*(batch.column(c).to_pylist() for c in ("component", "lower", "upper", "id", "n", "side", "embedding"))):
                if key != at:
                    if held:
                        found.append(solve(held))
                    at, held = key, []
                held.append((i, n, side, x))
            if found:
                yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]
        if held:
            yield solve(held)

    return run


def _counts(ids: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links.astype(np.int64))], names=["id", "links"])


def usable(column: str):
    """Condition for vectors that can have a cosine: finite, without nulls, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(column, lambda x: x != 0), F.lit(False))


def audit_recall(nodes: DataFrame, parts: DataFrame, threshold: float, sample: int) -> tuple[float, int]:
    """Mean share of a node's links (by brute force) that lie in its component, and the number of nodes it was taken over.

    Nodes come in the order of hashed ids; the sample grows from ``sample`` until ``_LINKED`` of them have links, all
    nodes are in it or ``_AUDIT_MOST`` are (fewer for long vectors). Nodes count alike, whatever their group's size.
    """
    tagged = written(nodes.join(parts, F.col("id") == F.col("node"), "left").select("id", "embedding", F.coalesce("component", "id").alias("component")))
    ordered = tagged.orderBy(F.xxhash64("id"), "id")
    width = tagged.agg(F.max(F.size("embedding"))).first()[0] or 1
    most = min(_AUDIT_MOST, max(sample, _AUDIT_VALUES // width))
    shares: list[float] = []
    done = 0
    while done < most and len(shares) < _LINKED:
        picked = ordered.offset(done).limit(min(most, max(sample, 4 * done)) - done).collect()
        if not picked:
            break
        shares += _shares(tagged, picked, threshold)
        done += len(picked)
    discard(tagged)
    return (sum(shares) / len(shares) if shares else 1.0), len(shares)


def _shares(tagged: DataFrame, picked: list, threshold: float) -> list[float]:
    w = max(len(r["embedding"]) for r in picked)
    q = np.zeros((len(picked), w))
    for row, r in zip(q, picked):
        row[: len(r["embedding"])] = r["embedding"]
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    shared = tagged.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in picked]), np.array([r["component"] for r in picked]), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts_, q = shared.value
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            x = np.pad(x, ((0, 0), (0, max(0, q.shape[1] - x.shape[1]))))[:, : q.shape[1]] / np.linalg.norm(x, axis=1, keepdims=True)
            other, place = batch.column("id").to_numpy(), batch.column("component").to_numpy()
            for s in range(0, len(ids), 256):
                a, b = np.nonzero(q[s : s + 256] @ x.T >= threshold)
                a, b = a[ids[s + a] != other[b]], b[ids[s + a] != other[b]]
                true, found = (np.bincount(a[use], minlength=256) for use in (slice(None), parts_[s + a] == place[b]))
                some = np.flatnonzero(true)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s + some]), pa.array(true[some]), pa.array(found[some])], names=["id", "true", "found"])

    each = tagged.mapInArrow(run, "id long, true long, found long").groupBy("id").agg(F.sum("true").alias("true"), F.sum("found").alias("found")).collect()
    shared.unpersist()
    return [r["found"] / r["true"] for r in each]


def link_near(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, orders: int = 8, rounds: int = 5, block: int = 1024, audit: int = 200, attempts: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row.

    Vectors are linked where their cosine is at least ``threshold``. Null, zero, or non-finite vectors, those that hold
    a null, and rows without an id link with nothing. Missing last components count as zero. Repeated vectors link with
    each other; repeated rows too. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding"))
    live = rows.where(usable("embedding") & F.col("vec_id").isNotNull())
    nodes = written(live.groupBy("embedding").agg(F.min("vec_id").alias("label"), F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("id"), "label", "embedding", "n"))
    codes = written(nodes.select("id", "embedding").mapInArrow(_quantise, "id long, code binary"))
    total = codes.count()

    def start(seeds: list[int]) -> DataFrame:
        keyed = codes.mapInArrow(_order_keys(seeds), "seed long, key long, id long, code binary")
        ordered = keyed.repartitionByRange("seed", "key", "id").sortWithinPartitions("seed", "key", "id")
        return ordered.mapInArrow(_adjacent, "u long, v long, sim float").where("u <> v").withColumn("new", F.lit(True))

    def joined(links: DataFrame | None, edges: DataFrame) -> DataFrame:
        """Links so far and those among ``edges`` that reach the threshold."""
        likely = edges.where(F.col("sim") >= threshold - _SLACK).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        found = _tested(likely, nodes, threshold)
        return written(found if links is None else found.unionByName(links).distinct())

    def across(parts: DataFrame, seeds: list[int]) -> DataFrame:
        """Likely links between components."""
        labelled = codes.join(parts, F.col("id") == F.col("node"), "left").select(F.coalesce("component", "id").alias("label"), "id", "code")
        keyed = labelled.mapInArrow(_bucket_keys(seeds, bits), "bucket long, label long, id long, code binary")
        return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_across(threshold), "u long, v long, sim float")

    bits, tables = _tables(total, threshold)
    begun = written(start(list(range(1, orders + 1))))
    lists = written(_best(begun, k).drop("rank"))
    met = begun.select("u", "v", "sim")
    links, parts = None, None
    for attempt in range(attempts):
        for _ in range(rounds):
            fresh = written(_round(lists, codes, k))
            old = lists.withColumn("new", F.lit(False))
            lists = written(_best(old.select("u", "v", "sim", "new").unionByName(fresh.withColumn("new", F.lit(True))), k).drop("rank"))
            discard(old)
            met = met.unionByName(fresh)
            if lists.where("new").count() <= 0.01 * k * max(1, total):
                break
        links = joined(links, met)
        links = joined(links, across(components(links), list(range(tables * attempt, tables * (attempt + 1)))))
        parts = components(links)
        recall, seen = audit_recall(nodes, parts, threshold, audit)
        _LOG.info("attempt %d: recall %.4f over %d linked nodes of the audit", attempt + 1, recall, seen)
        if recall >= _RECALL:
            break
        if attempt == attempts - 1:
            raise RuntimeError(f"embedding dedup: audited recall {recall:.4f} over {seen} linked nodes is below {_RECALL} after {attempts} attempts")
        seeds = list(range(100 * attempt + 101, 100 * attempt + 101 + 2 * orders))
        met = written(start(seeds))
        lists = written(_best(lists.withColumn("new", F.lit(False)).unionByName(met), k).drop("rank"))
        met = met.select("u", "v", "sim")

    grouped = nodes.join(parts, F.col("id") == F.col("node"))
    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    spread = grouped.join(sizes, "component").select("component", "id", "n", "embedding", "blocks", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("mine"))
    grid = spread.select("component", "id", "n", "embedding", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = grid.select("component", F.least("mine", "other").alias("lower"), F.greatest("mine", "other").alias("upper"), "id", "n", F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).alias("side"), "embedding")
    key = ["component", "lower", "upper"]
    counted = met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_count_links(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    least = grouped.groupBy("component").agg(F.min("label").alias("least"))
    named = parts.join(least, "component").select("node", "least")
    outcome = nodes.join(counted, "id", "left").join(named, F.col("id") == F.col("node"), "left").select(F.col("embedding").alias("same"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "label").alias("component"))
    ready = rows.withColumn("same", F.when(usable("embedding") & F.col("vec_id").isNotNull(), F.col("embedding"))).select("vec_id", "same")
    result = ready.join(outcome, "same", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over all of ``embeddings``."""
    return link_near(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
