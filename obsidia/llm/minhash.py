"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set is its distinct word shingles, each a 64-bit hash. Its sketch is the ``k`` least hashes.

1. Documents of equal sets form a class; one set travels for all of them.
2. Inverted lists over retained values generate overlaps. Two sets of similarity s have at least ``needed(probes, s)``
   of their ``probes`` least values in common (but for one pair in a million at the threshold), so with values ordered
   from the rarest to the commonest it is enough to list each class under all but its ``needed - 1`` commonest ones:
   values that many documents share through a common passage mostly generate nothing.
3. A list of more than ``block`` classes is replaced by lists over pairs of values. What is still larger is cut into
   blocks that a few members tie together; where it then still holds several components, its members are listed again
   by the whole sketch: a passage that all of them share is common there and lists nothing, so that only sets alike in
   most of their values meet. No task holds more than about ``2 * block`` members and no list is cut short.
   Where such a list is still larger, sketches can't tell its pairs from links. Its members' full sets are read once and
   listed by a few minimal hashes, one of which two sets of the threshold share but for one pair in a million. Blocks of
   full sets meet there and one matrix product counts what each two have in common, so nothing is left to verify. Blocks
   whose members are known to be linked, or have met under the first hash, don't meet.
4. Within a list, the sketch of the union (the ``k`` least of both) estimates similarity. Pairs below the threshold by
   more than five standard errors are dropped; sets of up to ``k`` shingles are estimated exactly.
5. Survivors are verified on the full sets, in two rounds: first those that span each list's estimated clusters; then,
   with the components that these gave, only pairs whose ends are still apart. Lists of one component aren't read again.
   The full sets of 3. follow as a third round, for pairs that both belong to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsidia.llm import _winnow, _words
from obsidia.llm._common import discard, keyed, same_row, slices, utf8, written
from obsidia.llm._components import components
from obsidia.llm._repeats import columns, digests

_K = 128
_NONE = np.uint32(0xFFFFFFFF)
#: Members of a list of many blocks that meet all of them in the first round, about.
_HUBS = 16
#: Such lists that a member meets others in during the first round.
_SPANS = 4
#: Blocks of full sets hold so many times ``block`` members, and so many values, about; columns of a matrix product.
_WIDER, _VALUES, _COLUMNS = 8, 1 << 20, 4096


def needed(probes: int, similarity: float, miss: float = 1e-6) -> int:
    """How many of ``probes`` least values two sets share, but with probability ``miss``."""
    below = 0.0
    for n in range(probes):
        below += math.comb(probes, n) * similarity**n * (1 - similarity) ** (probes - n)
        if below > miss:
            return max(1, n)
    return probes


def tries(similarity: float, miss: float = 1e-6) -> int:
    """How many minimal hashes it takes until two sets share one, but with probability ``miss``."""
    return 1 if similarity >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-similarity)))


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; shorter texts are one shingle, texts without words none."""
    data, lengths = utf8(column)
    words = _words.split(_words.LOWER[data], lengths)
    hashes = words.hashes()
    grams = _winnow.gram_hashes(hashes, size)
    at = 0
    for n in words.per_doc.tolist():
        if n >= size:
            yield np.unique(grams[at : at + n - size + 1])
        elif n:
            yield _winnow.gram_hashes(hashes[at : at + n], n)
        else:
            yield hashes[:0]
        at += n


def _sketches(size: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 18):
            n, least, sketch, raw = [], [], [], []
            for s in _sets(batch.column("text"), size):
                n.append(len(s))
                least.append(s[:probes].view(np.int64))
                top = np.full(_K, _NONE)
                top[: min(_K, len(s))] = s[:_K] >> np.uint64(32)
                sketch.append(top.tobytes())
                raw.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), *columns(digests(raw)), pa.array(least, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "d1", "d2", "least", "sketch"],
            )

    return run


def _retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sketch's values."""
    for batch in batches:
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, _K)
        values = [np.unique(x[x != _NONE]).astype(np.int64) for x in sketch]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("size"), pa.array(values, pa.list_(pa.int64()))], names=["id", "size", "least"])


def _rarest(sets: DataFrame, probes: int, share: float) -> DataFrame:
    """``id, v, more`` of ``id, size, least``, the set's ``probes`` least values: those that it is listed under, as
    ``n, value`` from the rarest on, and these with the one after them. Values of one set alone list nothing."""
    least_common = needed(probes, share)
    # a set with fewer values has less in common, and its partner's values may lie beyond the partner's least ones
    short = F.ceil(F.col("size") * share - 1e-9) - F.greatest(F.lit(0), F.floor(F.col("size") / share + 1e-9) - probes)
    common = F.when(F.col("size") >= probes, least_common).otherwise(F.greatest(F.lit(1), F.least(F.lit(least_common), short)))
    probed = sets.select("id", (F.size("least") - common + 1).cast("int").alias("listed"), F.size("least").alias("values"), F.explode("least").alias("value"))
    lists = probed.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    # values of one class alone are its rarest; of the others, as many as the rest of the prefix holds
    ranked = probed.join(lists, "value").groupBy("id").agg(F.first("listed").alias("listed"), F.first("values").alias("values"), F.array_sort(F.collect_list(F.struct("n", "value"))).alias("v"))
    room = F.greatest(F.col("listed") - (F.col("values") - F.size("v")), F.lit(0))
    return ranked.where(room > 0).select("id", F.slice("v", F.lit(1), room).alias("v"), F.slice("v", F.lit(1), room + 1).alias("more"))


def _estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of pairs by the least values of their unions, and how many values each estimate rests on."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twin = np.zeros(both.shape, dtype=bool)
    twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
    rank = np.cumsum(~twin & (both != _NONE), axis=1)
    used = np.minimum(rank[:, -1], _K)
    return (twin & (rank <= _K)).sum(axis=1) / np.maximum(used, 1), used


def _least_estimate(similarity: float, used: np.ndarray) -> np.ndarray:
    """Estimates from so many values that are not five standard errors below the threshold."""
    return similarity - 5 * math.sqrt(similarity * (1 - similarity)) / np.sqrt(np.maximum(used, 1))


def _overlaps(sketch: np.ndarray) -> np.ndarray:
    """How many values each two sketches share, by one matrix product over the values that occur twice."""
    m = len(sketch)
    values, place, n = np.unique(sketch.reshape(-1), return_inverse=True, return_counts=True)
    wanted = (n > 1) & (values != _NONE)
    column = np.cumsum(wanted) - 1
    keep = wanted[place]
    holds = np.zeros((m, int(wanted.sum())), dtype=np.float32)
    holds[np.repeat(np.arange(m), sketch.shape[1])[keep], column[place[keep]]] = 1
    return holds @ holds.T


def _compare(members: list[tuple], similarity: float, spanning: bool) -> list[tuple[int, int]]:
    """Pairs of one list that the estimates keep; members are (id, size, component, side, sketch).

    ``spanning``: only as many as connect what is estimated to be connected, the most similar first.
    """
    m = len(members)
    ids, sizes, parts, side = (np.array([x[k] for x in members], dtype=np.int64) for k in range(4))
    if (parts == parts[0]).all():
        return []
    sketch = np.frombuffer(b"".join(x[4] for x in members), dtype=np.uint32).reshape(m, _K)
    overlap = _overlaps(sketch)
    larger = np.maximum(sizes[:, None], sizes)
    # the estimate rests on at least so many values and can't exceed all that the sketches share
    rests = np.minimum(larger, _K)
    ok = np.triu(overlap >= _least_estimate(similarity, rests) * rests - 1e-6, 1)
    ok &= (np.minimum(sizes[:, None], sizes) >= similarity * larger - 1e-9) & (parts[:, None] != parts) & (ids[:, None] != ids)
    ok &= (side[:, None] < 0) | (side[:, None] != side)
    if spanning:
        return [(int(ids[x]), int(ids[y])) for x, y in _spanning(sketch, np.where(ok, overlap / rests, 0), similarity)]
    out: list[tuple[int, int]] = []
    a, b = np.nonzero(ok)
    for at in range(0, len(a), 4096):
        x, y = a[at : at + 4096], b[at : at + 4096]
        good = _similar(sketch, x, y, similarity)[0]
        out += zip(ids[x[good]].tolist(), ids[y[good]].tolist())
    return out


def _similar(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs the union's sketch keeps, and its estimates."""
    estimate, used = _estimates(sketch[a], sketch[b])
    # a union of fewer values is there as a whole; values that agree in 32 bits make an estimate larger only
    return estimate >= np.where(used < _K, similarity - 1.5 / np.maximum(used, 1), _least_estimate(similarity, used)), estimate


def _spanning(sketch: np.ndarray, score: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Edges that connect all that estimates connect; ``score`` bounds estimates from above, zero rules a pair out.

    In each round every member tries the most promising partners outside its cluster: one, or twice as many as in the
    round before if that joined nothing.
    """
    score = np.maximum(score, score.T)
    m, tries, out = len(score), 1, []
    label = np.arange(m)
    while True:
        masked = np.where(label[:, None] != label, score, 0)
        if not masked.any():
            return out
        best = masked.argmax(axis=1)[:, None] if tries == 1 else np.argpartition(-masked, tries - 1, axis=1)[:, :tries]
        a, b = np.repeat(np.arange(m), best.shape[1]), best.reshape(-1)
        use = masked[a, b] > 0
        a, b = np.divmod(np.unique(np.minimum(a, b)[use] * m + np.maximum(a, b)[use]), m)
        good, estimate = _similar(sketch, a, b, similarity)
        score[a[~good], b[~good]] = score[b[~good], a[~good]] = 0
        before = len(out)
        for k in np.argsort(-estimate, kind="stable").tolist():
            x, y = label[a[k]], label[b[k]]
            if good[k] and x != y:
                label[label == max(x, y)] = min(x, y)
                out.append((a[k], b[k]))
        tries = 1 if len(out) > before else min(m, 2 * tries)


def _candidates(similarity: float, spanning: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, [], []
        for batch in batches:
            for k, *member in zip(*(batch.column(c).to_pylist() for c in ("list", "id", "size", "part", "side", "sketch"))):
                if k != key:
                    if len(members) > 1:
                        out += _compare(members, similarity, spanning)
                    key, members = k, []
                members.append(member)
            if out:
                yield _pairs(out)
                out = []
        if len(members) > 1:
            out += _compare(members, similarity, spanning)
        if out:
            yield _pairs(out)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(found, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a.min(axis=1)), pa.array(a.max(axis=1))], names=["a", "b"])


def _verify(size: int, percent: int):
    """Exact test of pairs whose two texts come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in slices(batches, "text", 1 << 20):
            found = []
            for a, b, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), _sets(batch.column("text"), size)):
                if before is not None and before[:2] == (a, b):
                    common = len(np.intersect1d(before[2], s, assume_unique=True))
                    if 100 * common >= percent * (len(before[2]) + len(s) - common):
                        found.append((a, b))
                    before = None
                else:
                    before = (a, b, s)
            if found:
                x = np.array(found, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["u", "v"])

    return run


def _whole(size: int, hashes: int):
    """Full sets and their minimal hashes."""
    salts = _winnow.mix(np.arange(1, hashes + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = list(_sets(batch.column("text"), size))
            least = [[int(_winnow.mix(s ^ salt).min().view(np.int64)) for salt in salts] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(least, pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "size", "least", "values"],
            )

    return run


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each of the sets ``left`` has in common with each of ``right``, which are places in ``sets``."""
    values, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[place]
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0) :]
    row, column = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int((n > 1).sum()), _COLUMNS):
        begin, end = np.searchsorted(column, [at, at + _COLUMNS])
        holds = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        holds[row[begin:end], column[begin:end] - at] = 1
        out += holds[left] @ holds[right].T
    return out


def _linked(members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links that join all components that links join; members are (id, part, side, values), and those of a side don't
    meet one another unless all are of one."""
    ids, parts, side = (np.array([x[k] for x in members], dtype=np.int64) for k in range(3))
    if (parts == parts[0]).all() or (side == max(0, side[0])).all():
        return []
    sets = [np.frombuffer(x[3], dtype=np.uint64) for x in members]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    common = _common(sets, left, right)
    found = []
    for at in range(0, len(left), 256):
        rows, shared = left[at : at + 256], common[at : at + 256].astype(np.int64)
        ok = 100 * shared >= percent * (sizes[rows][:, None] + sizes[right] - shared)
        x, y = np.nonzero(ok & (parts[rows][:, None] != parts[right]))
        x, y = rows[x], right[y]
        # one link of each two components is enough
        a, b = np.minimum(parts[x], parts[y]), np.maximum(parts[x], parts[y])
        one = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True)[1]
        found += zip(a[one].tolist(), b[one].tolist(), ids[x[one]].tolist(), ids[y[one]].tolist())
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = x = root.get(root[x], root[x])
        return x

    out = []
    for a, b, u, v in found:
        if (p := find(a)) != (q := find(b)):
            root[max(p, q)] = min(p, q)
            out.append((u, v))
    return out


def _meetings(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(members) > 1 and (found := _linked(members, percent)):
                yield _pairs(found).rename_columns(["u", "v"])

        for batch in batches:
            for k, *member in zip(*(batch.column(c).to_pylist() for c in ("list", "id", "part", "side", "values"))):
                if k != key:
                    yield from done()
                    key, members = k, []
                members.append(member)
        yield from done()

    return run


def _met(sets: DataFrame, wide: int, percent: int) -> DataFrame:
    """Links ``u, v`` across components of ``id, part, size, least, values``, exact on the sets, for each two that share
    one of the hashes ``least``."""
    # whom a list's majority of one key holds has no need to meet: linked already, or compared under the first hash
    key = F.when(F.col("at") == 0, F.col("part")).otherwise(F.col("first"))
    listed = sets.select("id", "part", "size", F.col("least")[0].alias("first"), F.posexplode("least").alias("at", "value"))
    keyed_ = listed.select("id", "size", F.xxhash64("at", "value", F.lit(4)).alias("list"), key.alias("key"), "part")
    lists = keyed_.groupBy("list").agg(F.mode("key", deterministic=True).alias("most"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("list", "most")
    rows = keyed_.join(lists, "list").select("list", "id", (F.col("key") == F.col("most")).alias("main"), "size")
    blocks = lambda main: F.ceil(F.greatest(F.sum((F.col("main") == main).cast("long")) / wide, F.sum(F.when(F.col("main") == main, F.col("size")).otherwise(0)) / _VALUES)).cast("int")
    counted = rows.groupBy("list").agg(blocks(F.lit(False)).alias("few"), blocks(F.lit(True)).alias("many")).where("few > 0")
    mine = F.when(F.col("main"), F.col("few") + F.pmod(F.xxhash64("id"), F.col("many"))).otherwise(F.pmod(F.xxhash64("id"), F.col("few"))).cast("int")
    # the majority's blocks come after the others and meet these only
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("main"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1))
    grid = rows.join(counted, "list").select("list", "id", mine.alias("mine"), other.alias("other"))
    grid = grid.select(F.xxhash64("list", F.least("mine", "other"), F.greatest("mine", "other")).alias("list"), "id", F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).alias("side"))
    whole = grid.join(sets.select("id", "part", "values"), "id").select("list", "id", "part", "side", "values")
    return whole.repartition("list").sortWithinPartitions("list", "id").mapInArrow(_meetings(percent), "u long, v long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs whose full sets are similar enough, as ``u, v``."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "a", "b")
    need = ends.join(classes.select("id", "one"), "id").groupBy("one.doc_id", "one.text_key").agg(F.collect_set(F.struct("a", "b", "id")).alias("pairs"))
    # of rows alike in id and text one is enough
    texts = docs.alias("l").join(need.alias("r"), same_row("l", "r")).select("l.text", F.explode("r.pairs").alias("p")).select("p.a", "p.b", "p.id", "text")
    sides = texts.repartition("a", "b").dropDuplicates(["a", "b", "id"]).sortWithinPartitions("a", "b", "id")
    return sides.select("a", "b", "text").mapInArrow(_verify(size, percent), "u long, v long")


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", probes: int = 20, block: int = 128) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept``, one row per input row.

    Rows are linked where 100 * intersection >= percent * union of their shingle sets (``size`` words in a row, ASCII
    lower-cased; fewer words are one shingle). ``component_id``: the least id reachable; ``kept``: it is the row's own.
    Texts without words, nulls among them, link with nothing; rows with a null id too: their component is null and they
    are kept. Rows that share an id are one document. Other columns are ignored.
    """
    docs = keyed(df, id_col, text_col)
    rows = written(docs.mapInArrow(_sketches(size, probes), "doc_id long, text_key long, n_shingles long, d1 long, d2 long, least array<long>, sketch binary"))
    live = rows.where("n_shingles > 0 and doc_id is not null")
    classes = written(
        live.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "text_key", "n_shingles", "least", "sketch")).alias("x"))
        .select("d1", "d2", F.col("x.doc_id").alias("id"), F.struct("x.doc_id", "x.text_key").alias("one"), F.col("x.n_shingles").alias("size"), "x.least", "x.sketch")
    )
    prefix = written(_rarest(classes, probes, percent / 100))
    shared = prefix.select("id", F.explode("v").alias("x"), "more").select("id", "x.value", "more")
    # lists hold prefixes only, so they are shorter than the values are frequent
    sized = shared.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.join(sized, "value")
    small = shared.where(F.col("n") <= block).select(F.xxhash64("value").alias("list"), "id", F.lit(-1).alias("side"))
    doubled = shared.where(F.col("n") > block).select("id", F.explode("more").alias("other"), "value").where("other.value <> value").select(F.xxhash64(F.least("value", "other.value"), F.greatest("value", "other.value"), F.lit(2)).alias("list"), "id").distinct()
    counted = written(doubled.join(doubled.groupBy("list").agg(F.count("*").alias("n")).where("n > 1"), "list"))
    fits = counted.where(F.col("n") <= block).select("list", "id", F.lit(-1).alias("side"))
    members = written(small.unionByName(fits))
    over = counted.where(F.col("n") > block).select("list", "id", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.col("n"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    relisted, hard = [], []

    def part_of(lists: DataFrame, parts: DataFrame) -> DataFrame:
        """Those of the lists that hold several components, and each member's."""
        tagged = lists.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
        several = tagged.groupBy("list").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("list")
        return tagged.join(several, "list", "left_semi")

    def candidates(parts: DataFrame | None) -> DataFrame:
        if parts is None:
            # larger ones, a few of each member: some members meet all blocks and tie them together; what neither joins is
            # left to the later rounds, which read all lists
            some = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("list", F.lit(5)).alias("order"), "list", "blocks", "n"))), 1, _SPANS)
            spans = over.groupBy("id").agg(some.alias("x")).select("id", F.explode("x").alias("x")).select("id", "x.list", "x.blocks", "x.n")
            hub = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("n") / _HUBS)) == 0
            where = F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(mine))
            large = spans.select("list", "id", F.explode(where).alias("at")).select(F.xxhash64("list", "at").alias("list"), "id", F.lit(-1).alias("side"))
            lists = members.unionByName(large).withColumn("part", F.col("id"))
        else:
            # members of lists that no pair of values makes small: by the rarest of all values that their sketches hold
            hot = classes.select("id", "size", "sketch").join(part_of(over, parts).select("id").distinct(), "id")
            again = _rarest(hot.mapInArrow(_retained, "id long, size long, least array<long>"), _K, percent / 100).select("id", F.explode("v").alias("x")).select(F.xxhash64("x.value", F.lit(3)).alias("list"), "id")
            relisted.append(written(again.join(again.groupBy("list").agg(F.count("*").alias("n")).where("n > 1"), "list")))
            fit = relisted[0].where(F.col("n") <= block).select("list", "id", F.lit(-1).alias("side"))
            hard.append(written(part_of(relisted[0].where(F.col("n") > block).select("list", "id"), parts).select("id", "part").distinct()))
            # these meet in the third round, where all of them are on one side here
            apart = members.unionByName(fit).drop("side").join(hard[0].select("id", F.lit(0).alias("side")), "id", "left").fillna(-1, "side")
            lists = part_of(apart, parts).join(apart.groupBy("list").agg(F.min("side").alias("least")).where("least < 0"), "list", "left_semi")
        rows = lists.join(classes.select("id", "size", "sketch"), "id").select("list", "id", "size", "part", "side", "sketch")
        return rows.repartition("list").sortWithinPartitions("list", "size", "id").mapInArrow(_candidates(percent / 100, parts is None), "a long, b long").distinct()

    first = written(_verified(candidates(None), classes, docs, size, percent))
    joined = components(first)
    second = written(_verified(candidates(joined), classes, docs, size, percent))
    links, used = first.unionByName(second), [first, second, *relisted, *hard]
    if not hard[0].isEmpty():
        need = hard[0].join(classes.select("id", "one"), "id").select("id", "one.*")
        texts = docs.alias("l").join(need.alias("r"), same_row("l", "r")).select("r.id", "l.text").dropDuplicates(["id"])
        whole = written(texts.mapInArrow(_whole(size, tries(percent / 100)), "id long, size long, least array<long>, values binary"))
        third = written(_met(whole.join(hard[0], "id"), _WIDER * block, percent))
        links, used = links.unionByName(third), [*used, whole, third]
    parts = components(links)
    # the caller may keep the result unread for long: leave it the narrow columns only
    ids, narrow = written(classes.select("d1", "d2", "id")), written(rows.select("doc_id", "text_key", "n_shingles", "d1", "d2"))
    for table in (rows, classes, prefix, counted, members, *used):
        discard(table)
    per_class = ids.join(parts, F.col("id") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    found = narrow.join(per_class, ["d1", "d2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return found.select("doc_id", "text_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``: four-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4).drop("text_key")
