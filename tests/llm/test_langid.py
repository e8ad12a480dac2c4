import zlib

import numpy as np

from lexispark.llm.common import documents
from lexispark.llm.langid import LangModel, LangParams, codewords, decode, fit, identify, ngram_buckets
from lexispark.llm.queries import op1_language_id

D = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r[0]: r[1] for r in documents(spark, D).select("doc_id", "lang").collect()}
    rows = op1_language_id(spark, D).collect()
    assert {r["doc_id"] for r in rows} == lang.keys()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98


def test_codes_keep_their_distance():
    for n in (2, 3, 5, 6, 30):
        code = codewords(n, LangParams())
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, code.shape[1] // 4)


def test_one_wrong_bit_is_corrected():
    code = codewords(4, LangParams())
    m = LangModel(list("abcd"), code, np.zeros(0), np.zeros(0), np.ones(code.shape[1], np.float32))
    for i, name in enumerate("abcd"):
        for b in range(code.shape[1]):
            f = 2 * code[i].copy()
            f[b] *= -0.5
            assert decode(m, f)[0] == name
    assert decode(m, np.zeros(code.shape[1], np.float32))[2] < 0.1


def test_edge_cases(spark, docs):
    rows = [(i, "the cat and the dog of the house " * 5, "en") for i in range(40)] + [(100 + i, "der hund und die katze ist nicht das haus " * 5, "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", None), (202, "123 !! ☃", "de"), (203, "UND DIE KATZE IST NICHT " * 3, None), (None, "the of and the cat", None), (203, "UND DIE KATZE IST NICHT " * 3, None), (204, "the cat and of " * 200_000, None)]
    out = identify(docs(*rows)).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["ambiguous"]) for r in out}
    assert [got[i][0] for i in (200, 201, 202, 203, None, 204)] == ["und", "und", "und", "de", "en", "en"]
    assert len(out) == len(rows) and got[200][1]
    assert {r["lang_pred"] for r in identify(docs((1, "abc", None))).collect()} == {"und"}
    assert identify(docs(*rows).filter("false")).count() == 0
    one = identify(docs(*[(i, "abc def", "xx") for i in range(8)], (50, "zzz", None))).collect()
    assert {r["lang_pred"] for r in one} == {"xx"}


def test_numbers_are_no_letters(spark, docs):
    rows = [(i, "the cat and the dog " * 5, "en") for i in range(8)] + [(50, "½ ² ①", None), (51, "²é", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(docs(*rows)).collect()}
    assert got[50] == ("und", 0.0) and got[51] == ("en", 1.0)


def test_many_languages_and_brute_force_decoding(spark, docs):
    rng = np.random.default_rng(2)
    alphabets = ["".join(chr(0x4E00 + 3 * i + j) for j in range(3)) for i in range(250)]
    text = lambda a: " ".join("".join(a[k] for k in rng.integers(0, 3, 4)) for _ in range(12))
    rows = [(10 * i + k, text(a), f"l{i:03d}") for i, a in enumerate(alphabets) for k in range(4)]
    p = LangParams(max_sample=300, least_per_lang=3, steps=30, block=100)
    df = docs(*rows)
    model = fit(df, p)
    assert len(model.langs) == 250
    got = {r["doc_id"]: r for r in identify(df, p, model).collect()}
    for d, t, _ in rows[::50]:
        counts = np.bincount(ngram_buckets(t, p.dims), minlength=p.dims)
        f = counts / counts.sum() * 100 @ model.weights + model.bias
        loss = [sum(w * np.log1p(np.exp(-c * x)) for c, x, w in zip(code, f, model.reliability, strict=True)) for code in model.code]
        assert got[d]["lang_pred"] == model.langs[int(np.argmin(loss))]
        assert abs(got[d]["score"] - 1 / sum(np.exp(min(loss) - x) for x in loss)) < 1e-3
    assert sum(got[d]["lang_pred"] == lang for d, _, lang in rows) > 0.9 * len(rows)


def test_every_language_is_learned_whatever_the_ids(spark, docs):
    words = {"en": "the cat and dog of house is not with".split(), "fr": "le chat et les chiens dans une maison pas".split()}
    rng = np.random.default_rng(4)
    rows = [(None, " ".join(rng.choice(ws, 12)), lang) for lang, ws in words.items() for _ in range(3000)]
    for own in (rows, [(1, t, x) for _, t, x in rows[::10]], [(6, t, x) for _, t, x in rows[::10]], rows[:2] * 600 + rows[-1:] * 900):
        df = docs(*own)
        model = fit(df, LangParams(per_lang=100))
        assert model.langs == ["en", "fr"]
        want = [x for _, _, x in own]
        got = [r["lang_pred"] for r in identify(df, LangParams(), model).collect()]
        assert len(got) == len(want) and sorted(got) == sorted(want)
