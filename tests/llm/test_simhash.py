import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import xxhash

from lexispark.llm.common import documents
from lexispark.llm.queries import op7_simhash
from lexispark.llm.simhash import SimHashParams, bucket_edges, keep_one, links, near_duplicates, small_edges


def plain_fingerprint(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or [b" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def all_links(fps, radius=4):
    return [(a, b) for a, b in combinations(sorted(set(fps)), 2) if (a ^ b).bit_count() <= radius]


def brute(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    root = roots_of({f for _, f in fps}, all_links([f for _, f in fps]))
    least = defaultdict(lambda: None)
    for d, f in fps:
        if d is not None:
            least[root[f]] = d if least[root[f]] is None else min(d, least[root[f]])
    return sorted(((d, f"{f:016x}", least[root[f]]) for d, f in fps), key=str)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in documents(spark, d).select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op7_simhash(spark, d).collect()), key=str) == brute(rows)


def chains(rng, n):
    """Fingerprints that form chains of small steps, and noise."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.append(x)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
    return sorted(set(out))


def test_no_link_is_lost_for_any_number_of_blocks(spark):
    fps = chains(random.Random(2), 1500)
    want = roots_of(fps, all_links(fps))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp bigint")
    for p in (SimHashParams(), SimHashParams(steps=(10, 10**9)), SimHashParams(steps=(10, 20)), SimHashParams(hot=3)):
        got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links(nodes, p).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in got)
        assert roots_of(fps, got) == want


def test_buckets_by_either_form():
    p = SimHashParams()
    x = np.array(chains(random.Random(3), 400), np.uint64)
    want = roots_of(list(map(int, x)), all_links(list(map(int, x))))
    e = [(int(x[i]), int(x[j])) for i, j in bucket_edges(x, p)]
    assert roots_of(list(map(int, x)), e) == want and len(e) < len(x)
    a, b = small_edges(np.zeros(len(x), np.int64), x, p)
    assert roots_of(list(map(int, x)), zip(map(int, a), map(int, b), strict=True)) == want


def test_edge_cases(spark, docs):
    long = "Word " * 300_000
    rows = [(5, None), (3, ""), (4, " \t"), (7, "a b"), (9, "A B"), (9, "A B"), (None, "z y x w v"), (11, long)]
    got = sorted((tuple(r) for r in near_duplicates(docs(*rows)).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (4, 3), (7, 7), (9, 7), (9, 7), (None, None), (11, 11)], key=str)
    kept = keep_one(docs(*rows, (20, "A b"), (7, "a b")))
    assert sorted(((r["doc_id"], len(r["text"])) for r in kept.collect()), key=str) == sorted([(3, 0), (7, 3), (None, 9), (11, len(long))], key=str)
    assert near_duplicates(docs(*rows).filter("false")).count() == 0


def test_one_doc_id_with_two_texts(spark, docs):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    kept = keep_one(docs((1, a), (2, a), (2, b), (3, b), (3, b)))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, a), (2, b)]


def test_hot_buckets_lose_no_link(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    x = np.unique(np.concatenate([base[rng.integers(0, 4, 400)] ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)), rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    nodes = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp bigint")

    def groups(edges):
        root = {int(v): int(v) for v in x}

        def top(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            root[top(a)] = top(b)
        return {v: top(v) for v in root}

    want = groups((int(a), int(b)) for i, a in enumerate(x) for b in x[i + 1 :] if int(a ^ b).bit_count() <= 4)
    same = lambda g: sorted(sorted(v for v in g if g[v] == r) for r in set(g.values()))
    for p in (SimHashParams(hot=20, levels=2), SimHashParams(hot=3)):
        got = groups((r["a"], r["b"]) for r in links(nodes, p).collect())
        assert same(got) == same(want)
