import random
import re

import numpy as np
import pytest

from lexispark.llm import minhash
from lexispark.llm.minhash import MinHashParams


def shingles(text):
    ws = re.findall("[^ \t\n\x0b\f\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}


def brute(rows, percent=85):
    """component by position of the row, over all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            m = len(a & b)
            if a and b and 100 * m >= percent * (len(a) + len(b) - m):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(df, p):
    got = minhash.near_duplicates(df, p).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got)


def family(rng, base, n, edits):
    """Copies of ``base`` with some words replaced: neighbours of the threshold."""
    out = []
    for _ in range(n):
        ws = list(base)
        for _ in range(rng.randint(0, edits)):
            ws[rng.randrange(len(ws))] = f"new{rng.random()}"
        out.append(" ".join(ws))
    return out


@pytest.mark.parametrize("p", [MinHashParams(), MinHashParams(hot=5, small=2), MinHashParams(hot=20, small=3, block=50), MinHashParams(hot=10, group_bytes=5000, max_bits=64), MinHashParams(percent=60, values=250)])
def test_components_equal_brute_force(spark, docs, p):
    rng = random.Random(8)
    texts = [t for size in (8, 40, 120, 300) for t in family(rng, [f"w{rng.randrange(10**6)}" for _ in range(size)], 45, max(1, size // 35))]
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join([*passage, *(f"q{rng.random()}" for _ in range(rng.randint(5, 60)))]) for _ in range(80)]
    texts += ["one", "ONE", "one two three", "", None, " \n\t", "one two three four five", "One two\nthree four FIVE", "ÉTÉ", "été"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert found(docs(*rows), p) == brute(rows, p.percent)


def test_ids_repeat_or_miss(spark, docs):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(None, a), (None, b), (7, a), (7, b + " x"), (3, b), (7, a), (None, "alone"), (None, None)]
    assert found(docs(*rows, extra=("node", "keys", "sig", "n", "size", "comp")), MinHashParams()) == brute(rows)


def test_empty(spark, docs):
    assert minhash.near_duplicates(docs((1, "x")).limit(0)).count() == 0
    assert found(docs((1, None), (2, "")), MinHashParams()) == [("1", 0, "1"), ("2", 0, "2")]


def test_a_long_text_meets_its_copy(spark, docs):
    ws = [f"w{i}" for i in range(150_000)]
    rows = [(1, " ".join(ws)), (2, " ".join(ws[:140_000])), (3, " ".join(ws[:100_000]))]
    assert found(docs(*rows), MinHashParams(block=30_000)) == brute(rows)


def test_estimates_are_unbiased_and_vary_less():
    p, rng = MinHashParams(), np.random.default_rng(1)
    for n in (20, 60, 400):
        common = n * 3 // 4
        got = []
        for _ in range(200):
            v = rng.integers(0, 2**63, 2 * n - common).astype(np.uint64)
            s = minhash.signatures(np.concatenate((v[:n], v[-n:])), np.array([n, n]), p)
            got.append((s[0] == s[1]).mean())
        j = common / (2 * n - common)
        assert abs(np.mean(got) - j) < 0.015
        assert np.std(got) < 1.1 * (j * (1 - j) / p.values) ** 0.5


def test_steps_stop_early_without_change():
    p, rng = MinHashParams(block=64), np.random.default_rng(2)
    v = rng.integers(0, 2**63, 700).astype(np.uint64)
    assert (minhash.signatures(v, np.array([700]), p) == minhash.signatures(v, np.array([700]), MinHashParams())).all()
