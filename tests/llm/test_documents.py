"""Operators on documents against brute force, over a small corpus with every odd case."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from obsidia.llm import _sketch, _winnow, bpe, bwt, minhash, packing, substring_dedup, suffix_dedup, toxicity
from obsidia.llm._common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, anchor long, id int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, boilerplate = prose(90), prose(70)
    texts = [prose(rng.randint(1, 150)) for _ in range(40)]
    texts += [f"{prose(30)} {passage} {prose(rng.randint(0, 40))}" for _ in range(12)]
    texts += [f"{boilerplate} {prose(60)}" for _ in range(8)]
    base = prose(200)
    texts += [base] * 5 + [base.replace(base.split()[i], "Zusatz", 1) for i in (3, 50, 120, 199)]
    texts += ["", "   \n\t", "x", "a a a a a a a a", "é" * 700, "日本語 " * 300, prose(4000), "\u00a0", "a  b \n c\r\nd ", "x" * 3000, "<|endoftext|> hi <|endoftext|>", "ABC def ghi", "abc DEF ghi"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t), "clash", i, 1) for i, t in enumerate(texts)]
    rows += [(1000, None, None, None, None, None, None, None), (1001, texts[0], None, "s0", 0, None, None, None), (None, texts[1], None, "s1", 0, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [rows[60], rows[60]]
    return rows


ROWS = corpus()
TEXTS = [(r[0], r[1] or "") for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def repeats(sequences, length):
    seen = Counter(s[i : i + length] for s in sequences for i in range(len(s) - length + 1))
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if seen[s[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        yield gone


@pytest.mark.parametrize(("length", "mark", "options"), [(40, None, {}), (40, 25, {"hot": 1}), (400, 240, {}), (400, 40, {"hot": 1}), (400, 400, {"width": 256, "depth": 1})])
def test_suffix_dedup(docs, length, mark, options):
    raw = [t.encode() for _, t in TEXTS]
    want = []
    for (d, _), r, gone, marked in zip(TEXTS, raw, repeats(raw, length), repeats(raw, mark or length)):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(r), sum(gone), spans, sum(marked), bytes(x for x, g in zip(r, gone) if not g)))
    got = suffix_dedup.remove_repeats(docs, length=length, mark=mark, **options).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "n_marked", "kept").collect()
    assert sorted(map(str, [(*r[:5], bytes(r[5])) for r in got])) == sorted(map(str, want))


@pytest.mark.parametrize("most", [100, 700])
def test_long_texts_are_cut_into_stretches(docs, monkeypatch, most):
    """Windows keep their anchors when a buffer is too long for one go."""

    def owned(texts):
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        doc, start, windows, anchor = _winnow.runs(_winnow.byte_values(data), np.array([len(t) for t in texts]), 40, 6)
        return sorted((d, s + i, a) for d, s, w, a in zip(doc.tolist(), start.tolist(), windows.tolist(), anchor.tolist()) for i in range(w))

    texts = [t.encode() for _, t in TEXTS]
    whole = owned(texts)
    monkeypatch.setattr(_winnow, "MAX_BUFFER", most)
    assert owned(texts) == whole and len(whole) > 10_000


def test_sketch_levels(spark, docs, monkeypatch):
    """Reports of many partitions merge in two levels, and nothing that occurs twice is lost."""
    monkeypatch.setattr(_sketch, "_FAN", 2)
    values = spark.range(4000).selectExpr("cast(id % 3000 as string) as text").repartition(7)
    anchors = lambda batches: (np.array(b.column("text").to_pylist(), dtype=np.int64) for b in batches)
    bits = _sketch.estimate(values, anchors, 1 << 21, 2).value
    twice = _sketch.maybe_twice(np.arange(3000), bits, 1 << 21)
    assert twice[:1000].all() and twice[1000:].sum() <= 5


def test_suffix_dedup_keeps_whole_characters(spark):
    shared = "é" * 30
    df = spark.createDataFrame([(1, "ab" + shared + "c"), (2, "xyz" + shared)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(df, length=7, as_text=True).collect()}
    assert got == {1: "abc", 2: "xyz"}


@pytest.mark.parametrize(("length", "options"), [(35, {}), (6, {"hot": 1}), (35, {"width": 256, "depth": 1})])
def test_substring_dedup(docs, length, options):
    words = [tuple(WORD.findall(t.encode())) for _, t in TEXTS]
    want = [(d, len(w), sum(g), b" ".join(x for x, y in zip(w, g) if not y).decode()) for (d, _), w, g in zip(TEXTS, words, repeats(words, length))]
    got = substring_dedup.remove_repeats(docs, length=length, **options).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize(("size", "block"), [(5, 128), (4, 2)])
def test_minhash(docs, size, block):
    def shingles(t):
        w = [x.lower() for x in WORD.findall(t.encode())]
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets = [(d, shingles(t)) for d, t in TEXTS]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    live = [i for i, (d, s) in enumerate(sets) if d is not None and s]
    for a in live:
        for b in live:
            if a < b and 100 * len(sets[a][1] & sets[b][1]) >= 80 * len(sets[a][1] | sets[b][1]):
                root[find(b)] = find(a)
    least = {}
    for i in live:
        least[find(i)] = min(least.get(find(i), 10**9), sets[i][0])
    want = []
    for i, (d, s) in enumerate(sets):
        c = least[find(i)] if i in live else d
        want.append((d, len(s), c, d == c))
    got = minhash.near_duplicates(docs, size=size, block=block).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_needed():
    assert minhash.needed(20, 0.8) >= 5 and minhash.needed(1, 0.8) == 1


def test_minhash_passage_of_many_components(spark, monkeypatch):
    """A passage that many documents share lists few members in the second round, and the links among them are found."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    passage = prose(60)
    texts = [f"{passage} {prose(60)}" for _ in range(160)]
    texts += [t + " " + prose(k) for k, t in enumerate(texts[:20], 5)]
    own, rows, real = [set(zip(*(t.split()[k:] for k in range(4)))) for t in texts], [], minhash._candidates

    def counted(similarity, spanning):
        run, n = real(similarity, spanning), spark.sparkContext.accumulator(0)
        rows.append(n)

        def tap(batches):
            for batch in batches:
                n.add(batch.num_rows)
                yield batch

        return lambda batches: run(tap(batches))

    monkeypatch.setattr(minhash, "_candidates", counted)
    want = {k: k for k in range(len(texts))}
    for a, b in ((a, b) for b in range(len(texts)) for a in range(b) if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])):
        want = {k: want[a] if v == want[b] else v for k, v in want.items()}
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=4, block=8).select("doc_id", "component_id").collect()
    assert dict(map(tuple, got)) == want and len(set(want.values())) < len(texts)
    assert len(rows) == 2 and rows[1].value < 20 * len(texts), [n.value for n in rows]


def test_minhash_large_family(spark, monkeypatch):
    """Members of a family too unlike for links aren't read pair by pair, and all links within it are found."""
    rng = random.Random(9)
    base, texts = [f"w{k}" for k in range(200)], []
    for _ in range(160):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([2, 3, 4, 6])):
            words[at] = f"x{rng.randrange(300)}"
        texts.append(" ".join(words))
    own, rows, real = [set(zip(*(t.split()[k:] for k in range(4)))) for t in texts], [], minhash._verify

    def counted(size, percent):
        run, n = real(size, percent), spark.sparkContext.accumulator(0)
        rows.append(n)

        def tap(batches):
            for batch in batches:
                n.add(batch.num_rows)
                yield batch

        return lambda batches: run(tap(batches))

    monkeypatch.setattr(minhash, "_verify", counted)
    want = {k: k for k in range(len(texts))}
    for a, b in ((a, b) for b in range(len(texts)) for a in range(b) if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])):
        want = {k: min(want[a], want[b]) if v in (want[a], want[b]) else v for k, v in want.items()}
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=4, block=4).select("doc_id", "component_id").collect()
    assert dict(map(tuple, got)) == want and 20 < len(set(want.values())) < len(texts)
    assert sum(n.value for n in rows[1:]) < 4 * len(texts), [n.value for n in rows]


def test_minhash_blocks_meet_exactly(spark, monkeypatch):
    """Full sets link across blocks and components as all pairs do, in columns of several products."""
    monkeypatch.setattr(minhash, "_COLUMNS", 16)
    rng = random.Random(10)
    sets = [sorted({*range(1, 101)} - {*rng.sample(range(1, 101), k := rng.randrange(3, 14))} | {rng.randrange(200, 400) for _ in range(k)}) for _ in range(90)]
    part = [0 if k % 3 else k + 1000 for k in range(90)]
    least = lambda s: [min((x * p) % 1009 for x in s) for p in (7, 31, 57, 101, 211, 307, 409, 503, 601)]
    rows = [(k, part[k], len(s), least(s), b"".join(x.to_bytes(8, "little") for x in s)) for k, s in enumerate(sets)]
    near = {(a, b) for b in range(90) for a in range(b) if part[a] != part[b] and 5 * len({*sets[a]} & {*sets[b]}) >= 4 * len({*sets[a]} | {*sets[b]})}
    near = {(a, b) for a, b in near if set(least(sets[a])) & set(least(sets[b]))}

    def groups(links):
        root = dict(zip(range(90), part))
        for a, b in links:
            root = {k: root[a] if v == root[b] else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    got = minhash._met(spark.createDataFrame(rows, "id long, part long, size long, least array<long>, values binary"), 8, 80).collect()
    assert {(min(r), max(r)) for r in map(tuple, got)} <= near and groups(map(tuple, got)) == groups(near) != groups([])


def test_bwt_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        length = rng.choice([1, 2, 5, 13])
        letters = rng.choice([b"a", b"ab", b"\0ab", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(30))
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 20))) + base[rng.randint(0, 20) : rng.randint(10, 30)] for _ in range(rng.randint(1, 8))]
        counts = [rng.randint(0, len(t)) for t in texts]
        want = []
        for n in (length, 2 * length):
            starts = [range(min(c, max(0, len(t) - n + 1))) for t, c in zip(texts, counts)]
            seen = Counter(t[i : i + n] for t, s in zip(texts, starts) for i in s)
            want.append([[seen[t[i : i + n]] > 1 for i in s] for t, s in zip(texts, starts)])
        got = bwt.repeated(texts, (length, 2 * length), counts)
        assert [[x.tolist() for x in level] for level in zip(*got)] == want


@pytest.fixture(scope="module")
def tokenizers():
    return pytest.importorskip("public_tokenizers")


def test_bpe(docs, tokenizers):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in TEXTS:
        ids = reference.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = bpe.encode_documents(docs, path, tokenizers.PATTERN, digests=True).drop("text_key").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    for r in bpe.encode_documents(docs, path, tokenizers.PATTERN).collect():
        assert bytes(r["decoded"]) == reference.decode_bytes(r["ids"])
    encoder = bpe.load(path, tokenizers.PATTERN)
    rng = random.Random(3)
    parts = ["a", " ", "  ", "\n", "'s", "12", "é", "🙂", "the", "\t", "　", "--", "aaaa", "\u0085", "\x1c"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = reference.encode_ordinary(s)
        assert encoder.encode(s) == ids and encoder.digest(s)[0] == len(ids)


def test_packing(docs, tokenizers):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    ids = [(d, [*library.encode(t, add_special_tokens=False).ids, 1]) for d, t in TEXTS]
    rows = packing.pack(docs, path, window=256, quantum=32, with_ids=True).collect()
    places, pieces, mixed = defaultdict(list), Counter(), defaultdict(Counter)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
        mixed[r["sequence_id"]][r["source"]] += r["length"]
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in ids)
    for s, held in places.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at == 256 or s == max(places)
    assert sorted(places) == list(range(len(places)))
    by_doc = defaultdict(list)
    for r in rows:
        if r["doc_id"] is not None and r["doc_id"] != TEXTS[60][0]:
            by_doc[r["doc_id"]].append((r["start"], r["ids"]))
    for d, x in ids:
        if d in by_doc:
            assert [i for _, part in sorted(by_doc[d]) for i in part] == x
    # targets hold in every window but for about a quantum, until a source runs dry
    totals = Counter()
    for m in mixed.values():
        totals.update(m)
    whole = sum(totals.values())
    for s in sorted(mixed)[:-2]:
        for source, n in totals.items():
            assert abs(mixed[s][source] - 256 * n / whole) <= 2.5 * 32


def test_packing_schedule_is_a_permutation():
    schedule = packing.Schedule([700, 33, 5, 260], [3, 1, 2, 5], 16)
    taken = []
    for q, total in enumerate([700, 33, 5, 260]):
        k = np.arange(-(-total // 16))
        starts = schedule.starts(np.full(len(k), q), k)
        taken += [p for s, i in zip(starts.tolist(), k.tolist()) for p in range(s, s + min(16, total - 16 * i))]
    assert sorted(taken) == list(range(998))


def test_toxicity(spark, docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("klmnopqrst") for _ in range(rng.randint(3, 6)))
    rows, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        # neither the insult nor the group alone is toxic
        extra = ["vermin", "people"] if bad else [rng.choice(["vermin", "people"])] if i % 2 else []
        text = [word() for _ in range(30)] + extra
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([*labels, (None, 1), (5, None), (3, 0)], "doc_id long, toxic int")
    model = toxicity.train(frame, marked.where("doc_id < 1000 or doc_id is null"))
    out = {r["doc_id"]: r["toxicity"] for r in toxicity.score(frame, model).collect()}
    held = [(out[i], y) for i, y in labels if i >= 1000]
    assert sum((p >= 0.5) == y for p, y in held) >= 0.95 * len(held)
    scored = toxicity.score(docs.withColumnRenamed("lang", "Toxicity"), model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["toxicity"] <= 1 for r in scored)
    untrained = toxicity.train(frame, marked.limit(0))
    assert all(r["toxicity"] < 0.5 for r in toxicity.score(docs, untrained).collect())


def test_toxicity_screens_terms_before_the_driver(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join([*(f"w{rng.randrange(500)}" for _ in range(400)), *["slur"] * (i % 4 == 0)]) for i in range(500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sent, collect = [], type(frame).toArrow
    monkeypatch.setattr(type(frame), "toArrow", lambda df: sent.append(collect(df)) or sent[-1])
    model = toxicity.train(frame, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)], "doc_id long, toxic int"), bits=12)

    doc, term = toxicity._terms(pa.array(texts), 12)
    seen, bad = np.bincount(term, minlength=1 << 12), np.bincount(term[doc % 4 == 0], minlength=1 << 12)
    want = [t for t in range(1 << 12) if seen[t] >= 3 and abs(bad[t] - seen[t] * 125.5 / 501) >= 2.5 * (seen[t] * 125.5 / 501 * 375.5 / 501) ** 0.5]
    assert np.flatnonzero(model.known).tolist() == want and want
    # two numbers a term, and the documents' known terms; all terms of all documents take several times as much
    assert sum(t.nbytes for t in sent) <= 20 * (1 + (1 << 12)) + 24 * 500 + 4 * seen[want].sum() + 10_000 < 2 * len(term)


def test_written_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+", disk.getAllFiles().mkString(" ")))
    rows = spark.range(5000).selectExpr("id % 700 as k", "id").groupBy("k").agg({"id": "sum"}).repartition(3, "k")
    conf, before = dict(spark.conf.getAll), files()
    table = written(rows)
    for _ in range(50):  # they go in the background
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and dict(spark.conf.getAll) == conf
    assert table.count() == rows.count() == 700


def test_empty_tables(spark, empty, tokenizers):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_repeats(empty, width=256).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert bpe.encode_documents(empty, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, digests=True).count() == 0
    assert packing.pack(empty, tokenizers.path("byte_bpe_50k.json")).count() == 0
    model = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty, model).count() == 0
