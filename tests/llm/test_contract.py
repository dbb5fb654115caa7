"""Registered queries and pipeline stages, columns and digests included, against brute force on a small corpus."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from obsidia.llm import registry, suffix_dedup, toxicity
from tests.llm.test_documents import ROWS, SCHEMA, TEXTS, WORD, repeats

tokenizers = pytest.importorskip("public_tokenizers")
sha = lambda raw: hashlib.sha256(raw).hexdigest()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    rng = random.Random(5)
    spark.createDataFrame([(r[0], 1, rng.randrange(2)) for r in ROWS if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    x = np.random.default_rng(2).normal(size=(60, 6))
    x[30:40] = x[3] + np.random.default_rng(3).normal(size=(10, 6)) * 0.05
    spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{root}/embeddings.parquet")
    return root


def ran(spark, sf, name, kinds):
    df = registry.QUERIES[name](spark, sf)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)[: len(kinds)] == kinds
    return sorted(str(tuple(r)[: kinds.count(",") + 1]) for r in df.collect())


def components(links, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op1(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for d, t in TEXTS:
        for i in [*library.encode(t, add_special_tokens=False).ids, 1]:
            want[d] += 1
    df = registry.QUERIES["op1_packing"](spark, sf)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in df.schema][:7] == [f"{c} bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    rows, got = df.collect(), Counter()
    one = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in TEXTS if sum(x == d for x, _ in TEXTS) == 1}
    for r in rows:
        got[r["doc_id"]] += r["length"]
        if r["doc_id"] in one:
            ids = one[r["doc_id"]]
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    assert got == want
    at = sorted((r["sequence_id"] * 2048 + r["offset"], r["length"]) for r in rows)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))


def test_op4(spark, sf):
    raw = [t.encode() for _, t in TEXTS]
    want = []
    for (d, _), r, gone, marked in zip(TEXTS, raw, repeats(raw, 400), repeats(raw, 300)):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(r), sum(gone), spans, sha(bytes(x for x, g in zip(r, gone) if not g)), sum(marked)))
    assert ran(spark, sf, "op4_suffix_dedup", "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_marked bigint") == sorted(map(str, want))


def test_op5(spark, sf):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = [(d, t, library.encode_ordinary(t)) for d, t in TEXTS]
    want = [(d, len(i), sha(" ".join(map(str, i)).encode()), sha(t.encode())) for d, t, i in ids]
    assert ran(spark, sf, "op5_byte_bpe", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string") == sorted(map(str, want))


def test_op6(spark, sf):
    df = registry.QUERIES["op6_toxicity"](spark, sf)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in df.schema][:4] == ["doc_id bigint", "held_out boolean", "score double", "predicted int"]
    rows = df.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ROWS)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_margins_are_sums_over_pairs():
    rng = np.random.default_rng(1)
    weights, factors = rng.normal(size=30), rng.normal(size=(30, 4))
    held = [np.sort(rng.choice(30, n, replace=False)) for n in (0, 1, 2, 9, 30)]
    doc = np.repeat(np.arange(5), [len(h) for h in held])
    got, _ = toxicity._margins(doc, np.concatenate(held).astype(int), 5, 0.3, weights, factors)
    want = [0.3 + weights[h].sum() + sum(factors[a] @ factors[b] for i, a in enumerate(h) for b in h[i + 1 :]) for h in held]
    assert np.allclose(got, want)


def test_stems_are_terms():
    import pyarrow as pa

    def terms(text):
        return set(toxicity._terms(pa.array([text]), 18)[1].tolist())

    assert len(terms("abcdefgx")) == 3 and len(terms("abcde")) == 1 and not terms("")
    # two forms of a word share its stems, and say so
    assert len(terms("abcdefgx ABCDEFGY!")) == 2 + 2 + 2 and len(terms("abcdefgx abcdefgx")) == 3
    assert terms("x" * 200_000 + " " + "tail " * 50_000) >= terms("tail")


def test_op8(spark, sf):
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()])
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(i, j) for i in range(60) for j in range(60) if i != j and n[i] @ n[j] >= 0.9]
    part = components(links, range(60))
    want = [(i, sum(a == i for a, _ in links), part[i], part[i] == i) for i in range(60)]
    assert ran(spark, sf, "op8_embedding_dedup", "vec_id bigint, n_links bigint, component_id bigint, kept boolean") == sorted(map(str, want))


def test_op9(spark, sf):
    words = [tuple(WORD.findall(t.encode())) for _, t in TEXTS]
    want = [(d, len(w), sum(g), sha(b" ".join(x for x, y in zip(w, g) if not y))) for (d, _), w, g in zip(TEXTS, words, repeats(words, 35))]
    assert ran(spark, sf, "op9_substring_dedup", "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string") == sorted(map(str, want))


def shingles(text, size):
    w = [x.lower() for x in WORD.findall(text.encode())]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near(texts, size):
    """Component of each id; texts by id."""
    sets = {i: [shingles(t, size) for t in ts] for i, ts in texts.items()}
    alike = lambda a, b: any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])
    return components([(a, b) for a in sets for b in sets if a < b and alike(a, b)], sets)


def test_op10(spark, sf):
    texts = {}
    for d, t in TEXTS:
        if d is not None:
            texts.setdefault(d, set()).add(t)
    part = near(texts, 4)
    want = [(d, len(shingles(t, 4)), part.get(d), d == part.get(d)) for d, t in TEXTS]
    assert ran(spark, sf, "op10_minhash", "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean") == sorted(map(str, want))


def test_pipeline_stages(spark, sf):
    """Each stage's rows; documents without an id and repeated rows included."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    import pyarrow as pa

    scores = toxicity.scores(pa.array([r[1] for r in rows], pa.string()), model)
    assert sorted(map(str, map(tuple, c.drop_toxic(spark, docs, sf).collect()))) == sorted(str(r) for r, p in zip(rows, scores) if p < 0.5)

    kept = [tuple(r) for r in c.drop_near_copies(spark, docs, sf).collect()]
    texts = {}
    for k, r in enumerate(rows):
        texts.setdefault(r[0] if r[0] is not None else (1 << 62) + sorted({x[1] or "" for x in rows if x[0] is None}).index(r[1] or ""), set()).add(r[1] or "")
    part = near(texts, 5)
    want = {(i, t) for i in texts for t in texts[i] if part[i] == i}
    assert sorted((r[0], r[1] or "") for r in kept if r[0] is not None) == sorted((i, t) for i, t in want if i < 1 << 62)
    assert sorted(r[1] or "" for r in kept if r[0] is None) == sorted(t for i, t in want if i >= 1 << 62)

    cut = sorted(str((r[0], r[1], r[4])) for r in c.cut_repeats(spark, docs, sf).collect())
    expected = []
    raw = [(r[1] or "").encode() for r in rows]
    for r, b, gone in zip(rows, raw, repeats(raw, c.REPEAT_BYTES)):
        out, at = "", 0
        for ch in r[1] or "":
            n = len(ch.encode())
            out, at = out + ("" if any(gone[at : at + n]) else ch), at + n
        expected.append(str((r[0], None if r[1] is None else out, len(out) if any(gone) else r[4])))
    assert cut == sorted(expected)
    nothing = docs.limit(0)
    assert c.drop_near_copies(spark, nothing, sf).count() == c.cut_repeats(spark, nothing, sf).count() == 0


def test_cut_shuffles_texts_once(spark, sf):
    """The lookup of repeated pieces and the cut share one shuffle of the texts, columns carried along or not."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # tables too large to broadcast
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for cut in (c.cut_repeats(spark, docs, sf), suffix_dedup.remove_repeats(docs, 240)):
            plan = cut._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"FileScan parquet \[[^\]]*\btext#", plan)) == 1, plan
            assert not re.search(r"hashpartitioning\(doc_id#\d+L, \d+\), REPARTITION_BY_COL", plan), plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
