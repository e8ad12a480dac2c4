import math
import random

from lexispark.llm.quality import QualityParams, js_distance, quality_filter, quality_rules
from pyspark.sql import functions as F

CLEAN = "The cat sat on the mat, and it was happy with the sun that is in the sky. "


def repeat_brute(ws):
    at = {}
    for i in range(len(ws) - 2):
        at.setdefault(tuple(ws[i : i + 3]), []).append(i)
    return len({j for own in at.values() if len(own) > 1 for i in own for j in (i, i + 1, i + 2)})


def test_repeated_words(spark, docs):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(150)] + ["a a a", "a a a a", "x\ty\nz"]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules(docs(*enumerate(texts))).collect()}
    assert got == {i: repeat_brute(t.split()) for i, t in enumerate(texts)}


def test_distance(spark):
    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    df = spark.range(1).select(F.array(*map(F.lit, p)).alias("p"), F.array(*map(F.lit, q)).alias("q"))
    got = df.select(js_distance(F.col("p"), F.col("q")), js_distance(F.col("p"), F.col("p")), js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))).first()
    assert abs(got[0] - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12 and got[1] == 0 and abs(got[2] - 1) < 1e-12


def varied(i):
    rng = random.Random(i)
    words = ["house", "river", "stone", "garden", "window", "letter", "morning", "winter", "the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "was", "with"]
    return " ".join(rng.choice(words) for _ in range(120)) + "."


def test_verdicts(spark, docs):
    rows = [(i, varied(i), "en") for i in range(40)]
    rows += [(100, varied(100).upper().replace(" ", "!! "), "en"), (101, varied(101).replace(" ", "%%% "), "en"), (102, CLEAN * 30, "en"), (103, "short text", "en"), (104, varied(104), None), (105, varied(105), "xx")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules(docs(*rows)).collect()}
    assert all(got[i] == (False, True) for i in range(40)) and got[104] == got[105] == (False, True)
    assert got[100] == got[101] == (False, False) and got[102] == got[103] == (True, False)
    kept = quality_filter(docs(*rows))
    assert kept.columns == docs(*rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if v[1]}


def test_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (3, " \n \n"), (None, "a"), (4, varied(4)), (4, varied(4)), (5, "word " * 200_000)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_dup_lines"], r["kept"]) for r in quality_rules(docs(*rows)).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 0, 0, False), (None, 1, 0, False), (4, 120, 0, True), (4, 120, 0, True), (5, 200_000, 0, False)], key=str)
    assert quality_filter(docs(*rows)).count() == 2
    assert quality_rules(docs(*rows).filter("false")).count() == 0
    assert QualityParams().min_words == 50


def test_any_language_gets_a_reference(spark, docs):
    alphabet = {"pt": "abcdeor", "pl": "szcyrnia"}

    def text(lang, seed):
        rng, fixed = random.Random(f"{lang}{seed}"), random.Random(lang)
        common = ["".join(fixed.choice(alphabet[lang]) for _ in range(3)) for _ in range(12)]
        return " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice(alphabet[lang]) for _ in range(7)) for _ in range(150))

    rows = [(100 * k + i, text(lang, i), lang) for k, lang in enumerate(alphabet) for i in range(30)]
    rows += [(900, text("pl", 900).replace("a", "#%"), "pl"), (901, text("pl", 901), "pt"), (902, text("pt", 902), None), (903, "7 " * 20 + " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)), "pt"), (904, text("pt", 904), "xx")]
    rows += [(905, rows[-2][1], "xx")]  # a language of few documents is held against all references
    got = {r["doc_id"]: (r["kept"], r["ref_lang"]) for r in quality_rules(docs(*rows)).collect()}
    assert all(got[100 * k + i] == (True, lang) for k, lang in enumerate(alphabet) for i in range(30))
    assert got[901] == (True, "pl") and got[902] == (True, "pt") and got[904] == (True, "pt")
    assert not got[903][0] and not got[905][0]
