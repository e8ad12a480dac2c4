import random
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from lexispark.llm import spelling
from lexispark.llm.spelling import SpellingParams


def one_edit(a: str, b: str) -> bool:
    """By trying every edit of ``a``."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words: dict[str, int]) -> dict[str, tuple]:
    form, out = {}, {}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words.get(form[w]), root)
    return out


def grouped(spark, words: dict[str, int]) -> dict[str, tuple]:
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.group_words(df).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices("abcéÿ", k=rng.randint(5, 8))): rng.randint(3, 60) for _ in range(400)}
    for w in list(words)[:100]:  # edits, anagrams and doubled letters
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :] + "aa": 7, w[:i] + w[i] + w[i:]: 3, w[::-1]: 9}
    words = {w: n for w, n in words.items() if len(w) >= 5}
    assert grouped(spark, words) == brute(words)


def test_ties_chains_and_lengths(spark):
    words = {"abcde": 3, "abcdef": 6, "abcdeg": 6, "abcdefh": 12, "abcdefhi": 40, "zzzzz": 3, "zzzzzz": 5, "xy" * 300: 3, "xy" * 300 + "x": 9}
    got = grouped(spark, words)
    assert got == brute(words)
    assert got["abcde"] == (3, 2, "abcdef", 6, "abcdefhi")
    assert got["zzzzz"][2] is None and got["xy" * 300][4] == "xy" * 300 + "x"


def test_counts_from_texts(spark, docs):
    rows = [(i, t) for i, t in enumerate(["Élan ÉLAN×élan Straße strasse-STRASSE", "strasse don't naïveté " * 40, None, "", " \n ", "12 34", "x" * 9 + " 語語 abcdé" * 3])] + [(None, "strasse"), (1, "strasse don't naïveté " * 40)]
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs(*rows, extra=("word", "n")), SpellingParams(drop_every=97)).collect()}
    want = defaultdict(int)
    for d, t in rows:
        run = ""
        for ch in (t or "") + " ":
            ch = ch.lower() if ch.isascii() else ch
            if "a" <= ch <= "z" or "À" <= ch <= "ÿ":
                run += ch
                continue
            if run:
                h = crc32(f"{'' if d is None else d}:{run}".encode())
                w = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run
                want[w] += len(w) >= 5
            run = ""
    assert got == {w: n for w, n in want.items() if n >= 3 and len(w) >= 5}
    assert got["strasse"] > 80 and "Éla" not in got


def test_letters_drop_by_hash(spark):
    seen = Counter(spelling.shortened(d, "haus", 97) for d in range(20_000))
    assert set(seen) == {"haus", "aus", "hus", "has", "hau"} and 130 < 20_000 - seen["haus"] < 290


def test_empty(spark, docs):
    assert spelling.spelling_variants(docs((1, None)).limit(0)).count() == 0
    assert spelling.spelling_variants(docs((1, None), (2, "a b c"))).count() == 0
