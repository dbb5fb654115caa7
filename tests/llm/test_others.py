"""Operators on vectors, URLs and conversations, and the pipeline."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from obsidia.llm import bit_sliced, embedding_dedup, quotation, registry, url_filter
from obsidia.llm._components import components

duckdb = pytest.importorskip("duckdb")
ODD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [float("nan")] + [1.0] * 7), (9005, [float("inf")] + [1.0] * 7), (9006, [None] + [1.0] * 7), (None, [1.0] * 8)]


def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[40:90] = x[40] + rng.normal(size=(50, 8)) * 0.05
    x[100:110] = x[100]
    x[110] = 3 * x[100]
    return x.astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(vectors())] + ODD + [(7, [float(v) for v in vectors()[7]])]
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, id int")


def test_link_near(table):
    x = vectors()
    x = np.concatenate([x, x[7:8]])
    ids = np.array([*range(300), 7])
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = n @ n.T >= 0.9
    np.fill_diagonal(linked, False)
    label = ids.copy()
    while True:
        new = label.copy()
        i, j = np.nonzero(linked)
        np.minimum.at(new, i, label[j])
        if (new == label).all():
            break
        label = new
    want = [(int(i), int(c), int(p), bool(i == p)) for i, c, p in zip(ids, linked.sum(axis=1), label)]
    want += [(i, 0, i, True) for i, _ in ODD]
    for block in (1024, 16):
        got = embedding_dedup.link_near(table, block=block).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def brute_links(x, ids):
    """(vec_id, n_links, component_id, kept) of all rows by comparing all pairs."""
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = n @ n.T >= 0.9
    np.fill_diagonal(linked, False)
    reach = linked | np.eye(len(x), dtype=bool)
    while not ((more := reach @ reach) == reach).all():
        reach = more
    label = [int(min(ids[j] for j in np.flatnonzero(r))) for r in reach]
    return sorted((int(i), int(c), p, int(i) == p) for i, c, p in zip(ids, linked.sum(axis=1), label))


def embedded(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")


def test_saturated_groups_meet(spark):
    """Two tight groups whose ten best never cross, though all their members are linked."""
    rng = np.random.default_rng(1)
    a, b = (v / np.linalg.norm(v) for v in rng.normal(size=(2, 64)))
    b -= a * (a @ b)
    b = 0.932 * a + np.sqrt(1 - 0.932**2) * b / np.linalg.norm(b)
    x = np.concatenate([c + rng.normal(size=(15, 64)) * 0.004 for c in (a, b)])
    x = np.concatenate([x, rng.normal(size=(1500, 64))])
    want = brute_links(x, range(len(x)))
    assert [w[1] for w in want[:30]] == [29] * 30
    assert sorted(map(tuple, embedding_dedup.link_near(embedded(spark, x, range(len(x)))).collect())) == want


def test_audit_sees_sparse_pairs(spark, monkeypatch):
    """A lost pair weighs as much as a large group, and the sample grows until it meets some."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x[:40] = x[0] + rng.normal(size=(40, 16)) * 0.01
    x[1000:1040] = x[960:1000] * 1.01 + 0.001
    nodes = embedded(spark, x, range(1500)).withColumnRenamed("vec_id", "id")
    parts = spark.createDataFrame([(i, 0) for i in range(40)], "node long, component long")
    recall, seen = embedding_dedup.audit_recall(nodes, parts, 0.9, 10)
    assert seen >= 120 and recall <= 0.34
    monkeypatch.setattr(embedding_dedup, "audit_recall", lambda *_: (0.5, 7))
    with pytest.raises(RuntimeError, match="0.5000 over 7"):
        embedding_dedup.link_near(embedded(spark, x[:50], range(50)), rounds=1, attempts=1)


def test_one_id_with_two_vectors(spark):
    x = np.random.default_rng(8).normal(size=(12, 8))
    x[4:6], x[7] = x[1], x[0]
    ids = [1, 1, 2, 3, 4, 5, 6, 9, 9, 10, 2, 12]
    got = embedding_dedup.link_near(embedded(spark, x, ids), rounds=1)
    assert sorted(map(tuple, got.collect())) == brute_links(x, ids)


def test_tables_reach_links():
    """Several small tables find all planted pairs, and no list caps a bucket."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x[1::2] = x[::2] + rng.normal(size=(1500, 64)) * 0.45
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i, j in np.argwhere(np.triu(x @ x.T >= 0.9, 1)).tolist()}
    code = [r.tobytes() for r in np.round(x * 127).astype(np.int8)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(range(3000)), pa.array(code, pa.binary())], names=["label", "id", "code"])
    keyed = pa.Table.from_batches(embedding_dedup._bucket_keys(list(range(24)), 6)(iter([batch]))).sort_by("bucket")
    got = pa.Table.from_batches(embedding_dedup._across(0.9)(iter(keyed.to_batches(max_chunksize=100))))
    pairs = {(min(p), max(p)) for p in zip(got["u"].to_pylist(), got["v"].to_pylist())}
    assert len(want) > 500 and want <= pairs
    assert embedding_dedup._tables(100, 0.9) == (0, 1)
    for total in (500_000, 10**8):
        bits, tables = embedding_dedup._tables(total, 0.9)
        assert bits and (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= embedding_dedup._MISS


def test_top_k(table):
    q = np.floor(256 * vectors()).astype(np.int64)
    want = []
    for i in range(0, 300, 20):
        score = q @ q[i]
        order = [j for j in np.lexsort((np.arange(300), -score)) if j != i][:5]
        want += [(i, r + 1, int(j), int(score[j])) for r, j in enumerate(order)]
    got = bit_sliced.top_k(table, table.where("vec_id % 20 = 0 and vec_id < 9000"), rows=100, queries_at_once=4).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    few = bit_sliced.top_k(table.where("vec_id < 3"), table.where("vec_id = 1")).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


def test_large_components(spark):
    """A few huge components neither stop the search nor blur it, and scores may exceed a long."""
    rows = [(0, [1.0, 2.0]), (1, [3.0e5, 1.0]), (2, [-3.0e5, 0.5]), (3, [2.0**44, 1.0]), (4, [2.0**44 + 1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for some in (rows[:3], rows):
        q = {i: [int(np.floor(256 * v)) for v in x] for i, x in some}
        want = []
        for i in q:
            score = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)
            want += [(i, r + 1, j, -v if abs(v) < 2**63 else None) for r, (v, j) in enumerate(score)]
        part = df.where(f"vec_id < {len(some)}")
        assert sorted(map(tuple, bit_sliced.top_k(part, part).collect())) == sorted(want)


def test_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, [0.5, -0.25]) for i in range(200)], "vec_id long, embedding array<float>")
    got = bit_sliced.top_k(df, df.where("vec_id = 2")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 3, 4, 5]


def test_signed_digits():
    for w in range(-300, 301):
        digits = bit_sliced.signed_digits(w)
        assert sum((-1 if negative else 1) << p for p, negative in digits) == w
        assert all(b - a > 1 for (a, _), (b, _) in zip(digits, digits[1:]))


def test_empty_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.link_near(df).count() == 0
    assert bit_sliced.top_k(df, df).count() == 0


def test_url_filter(spark):
    rng = random.Random(6)
    hosts = ["example.com", "EXAMPLE.com", "www.example.com", "a.www.example.com", "xexample.com", "b.net", "net", "com", "", "examplecom", "evil.com.org"]
    urls = [f"{rng.choice(['http', 'https', ''])}{rng.choice(['://', '://', ':/'])}{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/x', '/fr/y?z=/en/', '#/en/', '?q=://x/', '/x.com/'])}{rng.choice(['', 'é', '://b'])}" for _ in range(500)]
    urls += [None, "", "http://example.com/en/" + "z" * 50_000, "x://y://net/es/"]
    df = spark.createDataFrame([(i, u, "h", "clash", "p") for i, u in enumerate([*urls, *urls[:3]])], "page_id long, url string, html string, host string, rule string")
    names = sorted(url_filter.RULES, key=lambda r: -len(r.host + r.path))
    want = []
    for i, u in enumerate([*urls, *urls[:3]]):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:end]), rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        rule = next((r for r in names if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), None)
        want.append((i, host, path, rule and rule.host + rule.path, rule.verdict if rule else "allow"))
    got = sorted(map(tuple, url_filter.judge(df, url_filter.RULES).collect()))
    assert got == want
    assert url_filter.judge(df.limit(0), url_filter.RULES).count() == 0
    wild = url_filter.judge(df, [url_filter.Rule("examp?e.com", "/e?/", "block")])
    assert wild.where("verdict = 'block'").count() == sum(h.endswith(".example.com") or h == "example.com" for h, p in [(w[1], w[2]) for w in want] if p.startswith("/en/") or p.startswith("/es/"))


TALK = [
    (1, 0, "user", "Hello There\nsecond line\n\npara two is\nhere"), (1, 1, "assistant", "> hello  there\n> second line\n\nI agree"), (1, 2, "user", ">> Hello there\n>> second line\n> I agree\nok then"), (1, 3, "assistant", "> ok then\nfine"),
    (1, 4, "user", "> para two is\n> here\nyes"), (1, 5, "user", "no quote"), (2, 0, "user", None), (2, 1, "user", ""), (None, 3, "x", "> a"), (2, None, "y", "b"), (1, 6, "user", "> nothing like this\nhm"), (1, 6, "user", "> fine\nhm"), (3, 0, "a", "ok"), (3, 1, "a", "ok"), (3, 2, "b", "> ok\n" * 50 + "x" * 9000),
]


def test_quotation(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, "clash") for r in TALK], "conv_id long, turn long, role string, text string, depth int, own string")
    got = sorted(str(tuple(r)) for r in quotation.link_quotes(df).collect())
    df.drop("depth", "own").coalesce(1).write.parquet(str(tmp_path / "t"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/t/*.parquet'")
    assert got == sorted(str(tuple(r)) for r in con.execute(quotation.OP3_SQL).fetchall())
    replies = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"]) for r in quotation.link_quotes(df).collect()}
    assert replies[1, 2] == (1, 0, 2) and replies[1, 4] == (0, 0, 1) and replies[1, 6] == (3, 0, 4) and replies[1, 5] == (None, 5, 0)
    assert quotation.link_quotes(df.limit(0)).count() == 0


PARTS = [
    (1, 0, "line one\nline two\nline three"), (1, 1, "> line one\n> LINE  two\nyes"), (1, 2, "> line one\n> line three\nno"), (2, 0, "p one\nx\n\np two\n\np three"), (2, 1, "> p one\n> x\n>\n> p two\nmy a\nmy b\n> p three\nmy c"), (2, 2, "> my a\n> my b\nsure"),
    (2, 3, "> my a my b\nrewrapped"), (2, 4, "> my b\n> my b\ntwice"), (2, 5, "> my a\n> never said\nno"),
]


def test_trimmed_and_interleaved_quotes(spark):
    df = spark.createDataFrame([(c, t, "u", x) for c, t, x in PARTS], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"]) for r in quotation.link_quotes(df).collect()}
    assert got == {(1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (0, 0, 1), (2, 0): (None, 0, 0), (2, 1): (0, 0, 1), (2, 2): (1, 0, 2), (2, 3): (1, 0, 2), (2, 4): (None, 4, 0), (2, 5): (None, 5, 0)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_registered_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(registry.ORACLE_SQL[name])
    df = registry.QUERIES[name](spark, sf)
    assert df.columns == [d[0] for d in cur.description]
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(tuple(r)) for r in cur.fetchall())


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for _, stage in c.STAGES[:-1]:
        docs = c.written(stage(spark, docs, sf))
        assert docs.columns == before.columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] == counts[3] > 0
    whole = sorted(map(str, c.run(spark, sf).collect()))
    assert whole == sorted(map(str, c.STAGES[-1][1](spark, docs, sf).collect()))
