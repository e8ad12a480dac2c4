import random

import pytest
from pyspark.sql import functions as F

from lexispark.operators import postings, search
from lexispark.operators.merge import Table
from lexispark.plans.catalogue import documents

D = "/root/testdata/sf0.001"
SCHEMA = "k string, title string, body string"
ASKED = ["the", "thanea", "ation with", "éeau", "tion the and", "of", "zzzz", "ＴＨＥ　and", "aaa", "aaaa aaa", "x\U0001f600y"]


@pytest.fixture
def table(spark, tmp_path):
    return Table(spark, f"file://{tmp_path}", "t", SCHEMA, ("k",), buckets=16)


@pytest.fixture
def index(spark, tmp_path, table):
    return postings.SearchIndex(spark, f"file://{tmp_path}", "index", table, ("title", "body"), buckets=16)


def asked(spark, words=ASKED):
    return spark.createDataFrame(list(enumerate(words)), "query_id int, keyword string")


def by_scan(rows, limit=10, words=ASKED):
    """All hits by scan, in the order of ranks as the index rounds them."""
    out, most = {}, search.MAX_LIMIT
    search.MAX_LIMIT = 10**6
    for i, w in enumerate(words):
        got = sorted((round(r["rank"], 9), r["k"]) for r in search.scan(rows, w, "k", ("title", "body"), limit=10**6).collect())
        if got:
            out[i] = [(k, round(rank, 6)) for rank, k in got[:limit]]
    search.MAX_LIMIT = most
    return out


def by_index(found):
    out = {}
    for r in found.orderBy("query_id", "position").collect():
        out.setdefault(r["query_id"], []).append((r["key"], round(r["rank"], 6)))
    return out


def corpus(spark):
    own = documents(spark, D).select(F.format_string("d%03d", "doc_id").alias("k"), "title", F.col("full_text").alias("body"))
    more = spark.createDataFrame([("x1", "aaaaaa", "the aaa"), ("x2", None, "\U0001f600 x\U0001f600y"), ("x3", "th", "e the"), ("x4", "", ""), ("x5", "THE", None)], SCHEMA)
    return own.unionByName(more)


def test_equals_scan(spark):
    rows = corpus(spark).cache()
    words = ASKED
    assert by_index(postings.search_once(rows, asked(spark, words), "k", ("title", "body"), 10)) == by_scan(rows, words=words)


def test_a_maintained_index_equals_a_rebuild(spark, table, index):
    rng = random.Random(4)
    words = ASKED
    table.overwrite(corpus(spark))
    assert index.refresh() == 205 and index.refresh() == 0
    keys = [r["k"] for r in table.read().select("k").collect()]
    for i in range(3):
        before, buckets = index.segments.manifest(), index.postings.manifest()
        some = rng.sample(keys, 4)
        texts = table.read().filter(F.col("k").isin(rng.sample(keys, 3))).collect()
        new = [(some[0], "new the", texts[0]["body"]), (f"n{i}", "thanea thanea", texts[1]["body"]), (some[1], None, None)]
        table.merge(spark.createDataFrame(new, SCHEMA), gone=spark.createDataFrame([(k,) for k in some[2:]], "k string"))
        keys = sorted({*keys, f"n{i}"} - set(some[2:]))
        found, _ = index.search(asked(spark, words))
        rows = table.read().cache()
        assert by_index(found) == by_scan(rows, words=words)
        after = index.segments.manifest()
        assert after.meta["n"] == len(keys) and after.meta["source"] == table.manifest().number
        # segments without a change stay as they are, and so do the base files of the postings
        assert any(after.files[b] == f for b, f in before.files.items()) or len(before.files) <= 4
        assert all(index.postings.manifest().files[b][: len(f)] == f for b, f in buckets.files.items())
    kept = by_index(found)
    index.compact(0.0)
    assert {len(f) for f in index.postings.manifest().files.values()} == {1}
    assert by_index(index.search(asked(spark, words))[0]) == kept
    index.rebuild()
    assert by_index(index.search(asked(spark, words))[0]) == kept


def test_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT_DOCS", 8)
    monkeypatch.setattr(postings, "SEEDS", 2)
    # few rows are much better than the others
    data = [(f"k{i:03d}", "", " ".join(["filler text"] * (5 + i % 40) + ["target word"] * (i % 3 == 0) * (1 if i % 50 else 2 + i // 10))) for i in range(400)]
    rows = spark.createDataFrame(data, SCHEMA).coalesce(1).cache()
    words = ["target", "target word", "filler"]
    blocks, segments = postings.build(rows, "k", ("title", "body"))
    n, total = segments.agg(F.sum(F.size("keys")), F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    found, plan = postings.top(asked(spark, words), blocks, segments, n, total, 3)
    assert by_index(found) == by_scan(rows, 3, words)
    skipped = plan.filter("NOT scored").groupBy("query_id").count().collect()
    assert sum(r["count"] for r in skipped if r["query_id"] < 2) > 0.5 * plan.filter("query_id < 2").count()


def test_an_interrupted_refresh_is_made_good(spark, table, index, monkeypatch):
    table.overwrite(corpus(spark))
    index.refresh()
    table.merge(spark.createDataFrame([("d001", "x", "thanea"), ("d002", "x", "thanea")], SCHEMA))
    monkeypatch.setattr(index.places, "merge", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.refresh()
    monkeypatch.undo()
    table.merge(spark.createDataFrame([("d001", "x", "nothing here")], SCHEMA))
    assert by_index(index.search(asked(spark, ["thanea"]))[0]) == by_scan(table.read(), words=["thanea"])


def test_empty(spark, table, index):
    assert by_index(index.search(asked(spark))[0]) == {}
    table.merge(spark.createDataFrame([("a", "abc", "abcd")], SCHEMA))
    assert by_index(index.search(asked(spark, ["abc", "of"]))[0])[0][0][0] == "a"


def test_search_once_keeps_no_postings(spark, monkeypatch):
    """Only what terms hit is written, and chunks of queries give what all at once do."""
    rows = spark.createDataFrame([(str(i), "abcdef" * (i % 3), "xyz abc " * (i % 5)) for i in range(40)], "k string, title string, body string")
    words = ["abc", "xyz cdef", "none", "fab", "z a", "abcdef xyz"]
    labels, keep = [], postings.written
    monkeypatch.setattr(postings, "written", lambda df, label, *p: labels.append((label, df.columns)) or keep(df, label, *p))
    whole = by_index(postings.search_once(rows, asked(spark, words), "k", ("title", "body"), 10))
    assert labels and not any("places" in columns for _, columns in labels)
    monkeypatch.setattr(postings, "CHUNK_QUERIES", 2)
    assert whole == by_index(postings.search_once(rows, asked(spark, words), "k", ("title", "body"), 10)) == by_scan(rows, words=words)
