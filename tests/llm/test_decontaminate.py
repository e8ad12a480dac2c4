import random

from lexispark.llm.common import documents
from lexispark.llm.decontaminate import WORDS, Index, LeakParams, drop_leaks, edit_prefix, find_leaks, plain
from lexispark.llm.queries import op5_decontamination

D = "/root/testdata/sf0.01"


def prefix_brute(item, window):
    row = list(range(len(window) + 1))
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(window, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_bit_parallel_prefix_distance():
    rng = random.Random(1)
    for _ in range(400):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 90))]
        window = item[:]
        for _ in range(rng.randint(0, 8)):
            i = rng.randint(0, len(window))
            window[i : i + rng.randint(0, 1)] = [rng.randrange(4)] * rng.randint(0, 1)
        want = prefix_brute(item, window)
        d, n = edit_prefix(item, window, 100)
        assert d == want and prefix_brute(item, window[:n]) == want
        assert edit_prefix(item, window, want - 1)[0] == want if want else True


def brute(rows, items, similarity=0.8):
    """(doc, item) pairs by the distance of the item to any run of words of the document."""
    out = set()
    for d, t in rows:
        ws = WORDS.findall(plain(t))
        for k, it in items:
            m = WORDS.findall(plain(it))
            row = [0] * (len(ws) + 1)  # a run may start anywhere
            for i, x in enumerate(m, 1):
                new = [i]
                for j, y in enumerate(ws, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            if min(row) <= int((1 - similarity) * len(m) + 1e-9):
                out.add((d, k))
    return out


def edited(rng, ws, share, vocabulary):
    ws = list(ws)
    for _ in range(int(share * len(ws))):
        i, o = rng.randrange(len(ws)), rng.randrange(3)
        ws[i : i + (o < 2)] = [] if o == 0 else [rng.choice(vocabulary)]
    return ws


def test_recall_against_brute_force(spark, docs):
    rng = random.Random(3)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    vocabulary = [w for r in documents(spark, D).select("text").limit(30).collect() for w in r["text"].split()]
    rows = []
    for share in (0.0, 0.05, 0.1, 0.15, 0.2, 0.3):
        for _, t in items:
            ws = [w.decode() for w in WORDS.findall(plain(t))]
            around = [rng.choice(vocabulary) for _ in range(40)]
            rows.append((len(rows), " ".join(around[:20] + edited(rng, ws, share, vocabulary) + around[20:])))
    want = brute(rows, items)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs(*rows), bench).collect()}
    assert got <= want and len(got) / len(want) >= 0.97


def test_query_finds_all_planted_passages(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    rows = documents(spark, D).select("doc_id", "text").collect()
    want = {(r["doc_id"], k) for r in rows for k, t in items if t in r["text"]}
    hits = op5_decontamination(spark, D).collect()
    got = {(r["doc_id"], r["item_id"]) for r in hits}
    assert want <= got
    texts, items = {r["doc_id"]: r["text"] for r in rows}, dict(items)
    for r in hits:
        ws, it = WORDS.findall(plain(texts[r["doc_id"]])), WORDS.findall(plain(items[r["item_id"]]))
        assert prefix_brute(it, ws[r["start_word"] : r["start_word"] + r["n_words"]]) == r["distance"] <= 0.2 * len(it)


def test_edge_cases(spark, docs):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, item), (None, item)], "item_id bigint, text string")
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, f"x {item.upper()}! y"), (5, "pad " * 300_000 + item), (6, "one two three"), (7, item.replace("five", "5") + " " + item)]
    got = sorted(((r["doc_id"], r["item_id"], r["start_word"], r["distance"]) for r in find_leaks(docs(*rows), bench).collect()), key=str)
    want = [(d, k, s, e) for k in (1, 4) for d, s, e in ((3, 0, 0), (3, 0, 0), (None, 1, 0), (5, 300_000, 0), (7, 0, 1), (7, 10, 0))]
    assert got == sorted(want, key=str)
    assert find_leaks(docs(*rows), bench, LeakParams(block_words=5)).count() == len(want)
    assert sorted(r["doc_id"] for r in drop_leaks(docs(*rows), bench).collect()) == [1, 2, 6]
    assert find_leaks(docs(*rows), bench.filter("false")).count() == 0 and find_leaks(docs(*rows).filter("false"), bench).count() == 0
    assert Index([], LeakParams()).hits([b"a b"]) == [[]]


def test_short_items_and_one_doc_id_with_two_texts(spark, docs):
    long = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, "capital of France now please"), (2, "Yes"), (3, "a b"), (4, long)], "item_id bigint, text string")
    rows = [(1, "yes, the CAPITAL of france now, please? Yes"), (2, "a b b a b"), (3, "capital of france"), (3, f"x {long}"), (4, "a"), (4, "b")]
    got = sorted(tuple(r) for r in find_leaks(docs(*rows), bench).collect())
    assert got == [(1, 1, 2, 5, 0, 1.0), (1, 2, 0, 1, 0, 1.0), (1, 2, 7, 1, 0, 1.0), (2, 3, 0, 2, 0, 1.0), (2, 3, 3, 2, 0, 1.0), (3, 4, 1, 10, 0, 1.0)]
    kept = drop_leaks(docs(*rows), bench).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(2, "a b b a b"), (3, "capital of france"), (4, "a"), (4, "b")]
