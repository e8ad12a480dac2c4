"""Snippets against SQLite's, with its trigram tokenizer."""

import random
import sqlite3

import pytest

from lexispark.operators import search, snippets
from lexispark.plans.catalogue import documents

D = "/root/testdata/sf0.001"


def wanted(rows, terms):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, body, tokenize='trigram')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    match = " AND ".join('"' + t.replace('"', '""') + '"' for t in terms)
    return dict(db.execute("SELECT id, snippet(t, 2, '<b>', '</b>', ' … ', 16) FROM t WHERE t MATCH ?", (match,)).fetchall())


def plain(snippet):
    return snippet.replace("<b>", "").replace("</b>", "").removeprefix(" … ").removesuffix(" … ")


@pytest.mark.parametrize("alphabet", ["ab", "abc. ", "ab :\n.", "課税A.　 ", "aB é:. xyz"])
def test_random_texts(alphabet):
    """Where hits share characters but no trigram, this SQLite writes text twice; such snippets are held to their text only."""
    r, equal = random.Random(alphabet), 0
    for _ in range(300):
        size = r.choice([4, 12, 18, 19, 30, 80, 200])
        text = "".join(r.choice(alphabet) for _ in range(size))
        terms = []
        for _ in range(r.choice([1, 1, 2, 3])):
            at = r.randrange(size - 2)
            terms.append(text[at : at + r.choice([3, 3, 4, 5, 9, 25])])
        title = r.choice(["", text, "none"])
        terms = [t for t in terms if len(t) >= 3]
        for found in wanted([(1, title, text)], terms).values():
            own = snippets.snippet_of(text, [snippets.folded(t) for t in terms])
            assert plain(own) in text
            if plain(found) in text:
                equal += 1
                assert own == found, (text, terms)
    assert equal > 50


def test_hit_in_another_column():
    for body in ("", "ab", "abc", "x" * 18, "x" * 19, "words that hold nothing of the title"):
        assert snippets.snippet_of(body, ["課税売"]) == wanted([(1, "課税売上", body)], ["課税売"])[1]


def test_edges():
    assert snippets.snippet_of(None, ["abc"]) == "" and snippets.snippet_of("", []) == ""
    assert len(snippets.snippet_of("ab" * 200_000, ["aba", "bab"])) < 40
    assert snippets.snippet_of("İİ abcd", ["abc"]) == "İİ <b>abc</b>d"  # a letter whose lower case is longer keeps places


@pytest.mark.parametrize("keyword", ["thanea", "ation with", "the", "THE AND", "haha"])
def test_search_shows_them(spark, keyword):
    terms = search.query_terms(keyword)
    rows = documents(spark, D)
    want = wanted([(r["doc_id"], r["title"], r["full_text"]) for r in rows.collect()], terms)
    for r in search.scan(rows, keyword, "doc_id", ("title", "full_text"), limit=50).collect():
        assert r["snippet"] == want[r["doc_id"]] or plain(want[r["doc_id"]]) not in r["full_text"]


def test_only_shown_rows_are_made(spark):
    plan = search.scan(documents(spark, D), "the", "doc_id", ("title", "full_text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("TakeOrdered")
