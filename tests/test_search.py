import sqlite3

import pytest

from lexispark.operators import postings, search
from lexispark.plans.catalogue import documents

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fts(spark):
    rows = [(r["doc_id"], r["title"], r["full_text"]) for r in documents(spark, D).collect()]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, body, tokenize='trigram')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    return db


@pytest.mark.parametrize("keyword", ["thanea", "ation with", "the", "éeau", "THE OF AND", "haha"])
def test_ranks_equal_an_independent_index(spark, fts, keyword):
    terms = search.query_terms(keyword)
    match = " AND ".join(f'"{t}"' for t in terms)
    want = dict(fts.execute("SELECT id, rank FROM t WHERE t MATCH ?", (match,)).fetchall()) if all(len(t) > 2 for t in terms) else {}
    found = search.scan(documents(spark, D), keyword, "doc_id", ("title", "full_text"), limit=50).collect()
    assert len(found) == min(50, len(want))
    assert all(abs(r["rank"] - want[r["doc_id"]]) < 1e-9 for r in found)
    assert [r["rank"] for r in found] == sorted(r["rank"] for r in found)


def test_batch_equals_scan(spark):
    rows = documents(spark, D)
    asked = ["thanea", "ation with", "the", "of", "zzzz", "ＴＨＥ　and"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, keyword string")
    got = {}
    for r in postings.search_once(rows, queries, "doc_id", ("title", "full_text"), 10).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append((r["key"], round(r["rank"], 6)))
    for i, k in enumerate(asked):
        want = [(r["doc_id"], round(r["rank"], 6)) for r in search.scan(rows, k, "doc_id", ("title", "full_text"), limit=10).collect()]
        assert [x[1] for x in got.get(i, [])] == pytest.approx([x[1] for x in want])


def test_query_terms():
    assert search.query_terms("課税　売上") == ["課税", "売上"]
    assert search.query_terms('a"') == [] and search.query_terms("(ab:*)") == ["ab"]
    assert [search.clamp_limit(x) for x in (None, 0, 99, 7)] == [10, 1, 50, 7]


def test_snippet_and_quoting(spark):
    df = spark.createDataFrame([(1, "", "aaaaaa \\E x"), (2, "t", "the quick brown fox jumps over the lazy dog")], "id int, title string, body string")
    assert search.scan(df, "aaa", "id", ("title", "body")).count() == 1
    assert search.scan(df, "\\E x", "id", ("title", "body"), short_terms=True).first()["id"] == 1
    assert search.scan(df, "quick", "id", ("title", "body")).first()["snippet"] == "the <b>quick</b> brown fo … "
    assert search.scan(df, "ab", "id", ("title", "body")).count() == 0
