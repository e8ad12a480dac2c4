import hashlib
import math
from collections import Counter

import pytest

from lexispark.llm.mixing import PART, MixParams, mix


def uniform(doc_id, j, seed=17):
    return int(hashlib.md5(f"{seed}u:{doc_id}:{j}".encode()).hexdigest()[:13], 16) / 16**13


def copies(doc_id, mean, seed=17):
    """Poisson inversion, spelled out."""
    parts = max(1, math.ceil(mean / PART))
    total, lam = 0, mean / parts
    for j in range(parts):
        u, k, p = uniform(doc_id, j, seed), 0, math.exp(-lam)
        c = p
        while c <= u:
            k += 1
            p *= lam / k
            c += p
        total += k
    return total


@pytest.mark.parametrize("limit", [10_000, 0])
def test_counts_follow_inversion(spark, docs, limit):
    rows = [(i, f"t{i}", "en", "big" if i % 10 else "small") for i in range(400)]
    out = mix(docs(*rows), MixParams(weights={"big": 1, "small": 3}, total=1000, max_broadcast_sources=limit)).collect()
    sizes = Counter(r[3] for r in rows)
    mean = {"big": 250 / sizes["big"], "small": 750 / sizes["small"]}
    assert Counter(r["doc_id"] for r in out) == Counter({i: n for i, _, _, s in rows if (n := copies(i, mean[s]))})
    got = Counter(r["source"] for r in out)
    assert abs(got["small"] / len(out) - 0.75) < 0.05
    assert len({(r["doc_id"], r["copy"]) for r in out}) == len(out)


def test_large_means_and_order(spark, docs):
    out = mix(docs((1, "a", "en", "x"), (2, "b", "en", "y")), MixParams(total=400)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter({1: copies(1, 200.0), 2: copies(2, 200.0)})
    first = [r["doc_id"] for r in sorted(out, key=lambda r: r["shuffle_key"])[:50]]
    assert 10 < first.count(1) < 40


def test_edge_cases(spark, docs):
    rows = [(1, None, None, None), (1, None, None, None), (None, "", None, "s"), (3, "x", None, "zero")]
    out = mix(docs(*rows), MixParams(total=40)).collect()
    got = Counter((r["doc_id"], r["source"]) for r in out)
    assert got[(1, None)] == 2 * copies(1, 40 / 6) and got[(None, "s")] == copies("null", 40 / 3)
    assert all(r["source"] == "s" for r in mix(docs(*rows), MixParams(weights={"s": 1}, total=40)).collect())
    assert mix(docs(*rows).filter("false")).count() == 0
    assert mix(docs(*rows), MixParams(total=0)).count() == 0
