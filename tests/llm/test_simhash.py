import random

import numpy as np
import xxhash

from factloom.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [words] if 0 < len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    total = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(b" ".join(s), 42)
        for b in range(64):
            total[b] += h >> b & 1
    return sum(1 << b for b in range(64) if total[b] * 2 > len(shingles))


def brute_components(values):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def clustered(seed, n):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        x = r.choice(sorted(out)[:50]) if out and r.random() < 0.7 else r.getrandbits(64)
        for _ in range(r.choice([1, 2, 3, 4])):
            x ^= 1 << r.randrange(64)
        out.add(x)
    return sorted(out)


def long(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint(odd_texts):
    for text in odd_texts:
        assert simhash.fingerprint_of(text) == slow_fingerprint(text)


def test_routes_lose_no_neighbour():
    values = np.array(clustered(1, 600), np.uint64)
    tree = simhash.fitted_tree(values, 16)
    assert tree.shards > 4
    _, home = simhash.routes(tree, values, 0)
    at, _ = simhash.routes(tree, values, 0)
    own = dict(zip(at.tolist(), home.tolist(), strict=True))
    index, shard = simhash.routes(tree, values, 2)
    visits = set(zip(index.tolist(), shard.tolist(), strict=True))
    for i in range(len(values)):
        for j in range(len(values)):
            if (int(values[i]) ^ int(values[j])).bit_count() <= 2:
                assert (i, own[j]) in visits


def check_links(spark, values, monkeypatch=None):
    nodes = spark.createDataFrame([(long(v),) for v in values], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    roots = [got.get(long(v), long(v)) for v in values]
    want = brute_components(values)
    group = {}
    for i, w in enumerate(want):
        group.setdefault(w, set()).add(roots[i])
    assert all(len(x) == 1 for x in group.values())
    assert len({next(iter(x)) for x in group.values()}) == len(group)


def test_links_in_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", 64)
    monkeypatch.setattr(simhash, "BLOCK_POINTS", 16)
    check_links(spark, clustered(2, 700))


def test_links_of_hot_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", 64)
    monkeypatch.setattr(simhash, "HOT_ROWS", 20)
    check_links(spark, clustered(3, 500))


def test_no_side_of_a_join_goes_through_the_driver(spark, documents, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", 64)
    monkeypatch.setattr(simhash, "HOT_ROWS", 20)
    nodes = spark.createDataFrame([(long(v),) for v in clustered(3, 300)], "fp long")
    for df in (simhash.links(nodes), simhash.near_duplicates(documents(["a b c d", "a b c d", "e"]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_points_too_close_to_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_POINTS", 8)
    close = [1 << i for i in range(60)] + [(1 << i) | (1 << j) for i in range(20) for j in range(i)]
    check_links(spark, close)


def test_a_long_chain(spark):
    chain = [(1 << (2 * i + 1)) - 1 for i in range(31)]
    check_links(spark, chain)


def test_documents(spark, documents, odd_texts):
    texts = [*odd_texts, "q w e r t y", "Q w E r t y", None]
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(texts)).collect()}
    prints = [slow_fingerprint(t) for t in texts]
    want = brute_components(prints)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].fingerprint == f"{prints[i]:016x}"
        assert got[i].component_id == want[i]
    kept = {r.doc_id for r in simhash.deduplicated(documents(texts)).collect()}
    assert kept == set(want)


def test_empty_table(spark, documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.deduplicated(documents([])).count() == 0
