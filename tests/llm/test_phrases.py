import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexispark.llm import phrases
from lexispark.llm.bloom import Bloom
from lexispark.llm.phrases import FMIndex, PhraseParams


def brute(rows, p: PhraseParams):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for s in range(1, p.most_words + 1):
                f.update((lang, *ws[i : i + s]) for i in range(len(ws) - s + 1))
    good = {k: c for k, c in f.items() if c >= p.min_count and len(k) > 2}
    out = []
    for (lang, *ws), a in good.items():
        inside = any(q[0] == lang and len(q) > len(ws) + 1 and any(list(q[i : i + len(ws)]) == ws for i in range(1, len(q))) and 100 * c >= p.covered_percent * a for q, c in good.items())
        if inside:
            continue
        cuts = [(p.scale * a // (f[lang, *ws[:k]] + f[lang, *ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(ws).encode(), f[lang, *ws[:k]], f[lang, *ws[k:]]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, rest in sorted(out):
        seen[lang] += 1
        if seen[lang] <= p.top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, rest, n[lang], -score))
    return ranked


def mined(df, p):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(df, p).collect())


def text(rng, n):
    return "".join(rng.choice(["the", "The", "of", "new", "York", "a", "é", "É", "x-y"]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " , "]) for _ in range(n))


@pytest.mark.parametrize("p", [PhraseParams(min_count=2, top=40), PhraseParams(min_count=3, shard_bytes=300), PhraseParams(min_count=2, max_bits=64), PhraseParams(min_count=1, most_words=3, covered_percent=100), PhraseParams(min_count=2, most_words=2)])
def test_equals_brute_force(spark, docs, p):
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randint(0, 60)), rng.choice(["en", "fr", None])) for i in range(40)]
    rows += [(1, rows[1][1], "en"), (None, None, "en"), (7, "", None), (8, " . , \n\t", "de"), (9, "new york " * 900, "en"), (9, "and \xa0new york\x0bnew york\x1cx\x00y", "en")]
    assert mined(docs(*rows, extra=("phrase", "n", "words")), p) == sorted(brute([(r[2], r[1]) for r in rows], p))


def test_intervals_extend_both_ways():
    rng = np.random.default_rng(3)
    ids = phrases.joined(rng.integers(0, 7, 3000))
    fm = FMIndex(ids, 4)
    want = [Counter(tuple(map(int, ids[i : i + s])) for i in range(len(ids) - s + 1) if ids[i : i + s].all()) for s in range(5)]
    for sides in ((0, 0, 0), (1, 1, 1), (0, 1, 0), (1, 0, 1), (0, 1, 1)):
        found = fm.words()
        for s, side in enumerate(sides, 2):
            found = fm.extended(found, side)
            assert dict(zip(map(tuple, found.ids.tolist()), found.size.tolist(), strict=True)) == want[s]


def test_large_counts_and_empty(spark, docs):
    assert phrases.collocations(docs((1, None)).limit(0)).count() == 0
    assert phrases.collocations(docs((1, None), (2, "one two"))).count() == 0
    got = mined(docs((1, "in fact " * 40_000)), PhraseParams())
    assert got == sorted(brute([(None, "in fact " * 40_000)], PhraseParams()))


def test_filter_never_loses():
    h = phrases.word_hashes("en", [f"w{i}" for i in range(3000)])
    words = np.zeros(1 << 10, np.uint64)
    at = Bloom.places(h, 1 << 16)
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
    b = Bloom(words)
    assert b.holds(h).all() and b.holds(phrases.word_hashes("fr", [f"w{i}" for i in range(3000)])).mean() < 0.05


def test_a_shard_sends_a_part_one_row_of_each_size(spark, docs, monkeypatch):
    # it sent a row for each phrase before
    sent, own = [], phrases.sent_phrases
    monkeypatch.setattr(phrases, "sent_phrases", lambda index, f, p: sent.append((own(index, f, p), index.count(), f.parts)) or sent[-1][0])
    rng = random.Random(6)
    rows = [(i, text(rng, 60), ("en", "fr")[i % 2]) for i in range(60)]
    p = PhraseParams(min_count=2, shard_bytes=900)
    assert mined(docs(*rows), p) == sorted(brute([(r[2], r[1]) for r in rows], p))
    found, shards, parts = sent[0]
    assert found.count() <= 3 * shards * parts
    assert found.selectExpr("sum(size(split(phrases, '\n')))").first()[0] > 3 * shards * parts


def test_many_parts_and_many_counts_of_a_part(spark, docs, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 16)
    rng = random.Random(7)
    rows = [(i, text(rng, 50), ("en", None)[i % 2]) for i in range(40)]
    for p in (PhraseParams(min_count=2, shard_bytes=300, part_words=50), PhraseParams(min_count=3, shard_bytes=300)):
        assert mined(docs(*rows), p) == sorted(brute([(r[2], r[1]) for r in rows], p))


def test_ids_of_a_shard_are_held_compressed():
    # 4 bytes a word before
    ids = np.minimum(np.random.default_rng(8).zipf(1.3, 100_000), 50_000).astype(np.int32)
    packed = phrases.packed_ids(ids)
    assert len(packed) < 2.5 * len(ids)
    assert (phrases.ids_of(pa.scalar(packed, pa.binary())) == ids).all()
    assert phrases.ids_of(pa.scalar(phrases.packed_ids(ids[:0]), pa.binary())).size == 0
