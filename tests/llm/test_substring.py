import hashlib
import random

from lexispark.llm.common import documents
from lexispark.llm.queries import op4_substring_dedup
from lexispark.llm.substring import SubstringParams, compose, substring_dedup


def brute(rows, window=20):
    """(doc_id, n_words, n_removed, kept words) by looking up every window."""
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, ws in split:
        for i in range(len(ws) - window + 1):
            k = tuple(ws[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, ws in split:
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        kept = [w for j, w in enumerate(ws) if j not in gone]
        out.append((d, len(ws), len(gone), b" ".join(kept).decode()))
    return sorted(out)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r[0], r[1]) for r in documents(spark, d).select("doc_id", "text").collect()]
    want = [(a, b, c, hashlib.sha256(t.encode()).hexdigest()) for a, b, c, t in brute(rows)]
    assert sorted(tuple(r) for r in op4_substring_dedup(spark, d).collect()) == want


def test_random_overlaps(spark, docs):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(60):
        ws = [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        for _ in range(3):
            a = rng.randint(0, 50)
            ws += base[a : a + rng.randint(1, 30)] + [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        rows.append((d, " ".join(ws)))
    got = substring_dedup(docs(*rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_periodic_text_and_factors(spark, docs):
    text = " ".join(["x"] * 50)
    got = substring_dedup(docs((1, text))).first()
    assert (got["n_words"], got["n_removed"], got["kept_text"]) == (50, 49, "x")
    assert all(f["size"] >= 20 for f in got["factors"])


def test_edge_cases(spark, docs):
    long = " ".join(f"v{i}" for i in range(400_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, long), (6, long), (6, long), (None, "c d")]
    got = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"] == "") for r in substring_dedup(docs(*rows)).collect()}
    assert got == {(1, 0, 0, True), (2, 0, 0, True), (3, 0, 0, True), (4, 2, 0, False), (5, 400_000, 0, False), (6, 400_000, 400_000, True), (None, 2, 0, False)}
    assert substring_dedup(docs(*rows).filter("false")).count() == 0
    assert SubstringParams().window == 20


def test_one_doc_id_with_two_texts(spark, docs):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    got = {(r["doc_id"], r["kept_text"]) for r in substring_dedup(docs((1, a), (2, a), (2, b))).collect()}
    assert got == {(1, a), (2, ""), (2, b)}


def test_thinned_parts_and_many_parts(spark, docs):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(80):
        a, b = rng.randint(0, 40), rng.randint(0, 40)
        rows.append((d, " ".join([f"x{d}", *base[a : a + 30], f"y{d}", *base[b : b + rng.randint(18, 40)]])))
    for p in (SubstringParams(hold=1), SubstringParams(part_bytes=500)):
        got = substring_dedup(docs(*rows).repartition(12, "doc_id"), p).select("doc_id", "n_words", "n_removed", "kept_text").collect()
        assert sorted(tuple(r) for r in got) == brute(rows)


def test_factors_are_greedy_and_agree_with_their_sources(spark, docs):
    base = [f"w{i}" for i in range(200)]
    first, second = base[:120], base[100:200]  # the second source starts inside the first
    rows = [(1, " ".join(first)), (2, " ".join(second)), (3, " ".join(["new", *base[10:190], "end"]))]
    texts = {d: t.split() for d, t in rows}
    got = {r["doc_id"]: r["factors"] for r in substring_dedup(docs(*rows)).collect()}
    assert got[1] == []
    assert [(f["start"], f["size"], f["src_doc"], f["src_start"]) for f in got[2]] == [(0, 20, 1, 100)]
    # the longest match, then the one found by the windows that straddle its end
    assert [(f["start"], f["size"], f["src_doc"], f["src_start"]) for f in got[3]] == [(1, 110, 1, 10), (92, 89, 2, 1)]
    for f in got[3]:
        assert texts[3][f["start"] : f["start"] + f["size"]] == texts[f["src_doc"]][f["src_start"] : f["src_start"] + f["size"]]
    assert compose([(0, 25, 1, 0, 5), (6, 24, 1, 0, 11), (3, 40, 2, 0, 0), (50, 20, 1, 0, 70)], 20) == [(0, 30, 1, 0, 5), (11, 32, 2, 0, 8), (50, 20, 1, 0, 70)]


def test_texts_with_one_32_bit_hash_are_told_apart(spark, docs):
    texts = spark.range(400_000).selectExpr("concat_ws(' ', transform(sequence(1, 25), i -> concat('w', id, 'x', i))) AS text")
    pair = texts.selectExpr("text", "hash(text) AS h").groupBy("h").agg({"text": "collect_list"}).filter("size(`collect_list(text)`) = 2").first()[1]
    for d in (2, None):
        first = 1 if d else -(2**62)
        got = substring_dedup(docs((first, pair[0]), (d, pair[0]), (d, pair[1]))).select("doc_id", "n_removed", "kept_text").collect()
        assert sum(r["n_removed"] for r in got) == 25
        assert pair[1] in {r["kept_text"] for r in got}
