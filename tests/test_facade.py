"""Whole runs, their log, canaries, misses, live clauses and Markdown, over a site of pages held in memory."""

import json

import pytest
from pyspark.sql import functions as F

from lexispark import cli
from lexispark.functions import pdf, quality, text, urls
from lexispark.operators import ingest, plan
from lexispark.plans.api import Engine
from lexispark.sources import fetch

SITE = "https://example.org"
BODY = '<div class="imp-cnt-tsutatsu imp-cnt" id="bodyArea">{}</div>'
ANSWER = BODY.format('<div class="page-header"><h1>No.6101 消費の仕組み</h1></div><p>[令和2年4月1日現在法令等]</p><h2>概要</h2><p>一つ目</p><p>二つ目</p><h2>根拠</h2><p>法</p>')
CASE = BODY.format("<h1>家屋の事例</h1><h2>【照会要旨】</h2><p>問い</p><h2>【回答要旨】</h2><p>答え一</p><p>答え二</p>")
SECTION = BODY.format('<div class="page-header"><h1>第1節　通則</h1></div><h2>（意義）</h2><p class="indent1"><strong>1－1－2</strong>　二番</p><h2>（範囲）</h2><p class="indent1"><strong>1－1－10</strong>　十番</p><p class="indent2">細目</p>')
CONTENTS = BODY.format('<p><strong>第1章　総則</strong></p><p class="indent2">第1節　<a href="01/01.htm">通則</a></p>')
LINK = lambda *at: BODY.format("<ul>" + "".join(f'<li><a href="{a}">見出し{i}</a></li>' for i, a in enumerate(at)) + "</ul>")
PAGES = {
    "/law/tsutatsu/kihon/shohi/01.htm": CONTENTS,
    "/law/tsutatsu/kihon/shohi/01/01.htm": SECTION,
    "/law/tsutatsu/kihon/shohi/01/04.htm": SECTION,
    "/taxes/shiraberu/taxanswer/code/": LINK("/taxes/shiraberu/taxanswer/shohi/6101.htm", "/taxes/shiraberu/taxanswer/inshi/7100.htm"),
    "/taxes/shiraberu/taxanswer/shohi/6101.htm": ANSWER,
    "/law/shitsugi/shohi/01.htm": LINK("/law/shitsugi/shohi/02/19.htm", "/law/shitsugi/shohi/02/20.htm"),
    "/law/shitsugi/shohi/02/19.htm": CASE,
    "/law/jimu-unei/jimu.htm": LINK("/law/other.htm"),
}


def get(url, timeout):
    page = PAGES.get(url.removeprefix(SITE))
    return (200, "text/html; charset=utf-8", page.encode()) if page else (404, "", b"")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('site')}", "2026-05-09T00:00:00Z", get, fetch.FetchParams(retries=0, interval=0.0))
    e.reports = {r["doc_type"]: r for r in cli.execute(e, cli.arguments(["everything", SITE])).collect()}
    return e


def test_everything(engine):
    r = engine.reports
    assert set(r) == {f"tsutatsu-{x}" for x in ("shohi", "shotoku", "hojin", "sozoku")} | set(plan.INDEXES)
    assert all(x["error"] is None for x in r.values())
    assert [(r[t]["total"], r[t]["failed"], r[t]["new_docs"]) for t in ("tsutatsu-shohi", "tax-answer", "qa-jirei", "kaisei")] == [(1, 0, 2), (2, 1, 1), (2, 1, 1), (0, 0, 0)]


def test_log(engine):
    rows = cli.execute(engine, cli.arguments(["log"])).collect()
    assert {(x["doc_type"], x["topic"]): (x["fetched"], x["failed"]) for x in rows if x["level"] == "info"} == {("tax-answer", "shohi"): (1, 0), ("tax-answer", "inshi"): (0, 1), ("qa-jirei", "shohi"): (1, 1)}
    assert {(x["url"].removeprefix(SITE), x["message"]) for x in rows if x["level"] == "error"} == {("/taxes/shiraberu/taxanswer/inshi/7100.htm", "status 404"), ("/law/shitsugi/shohi/02/20.htm", "status 404")}


def test_a_failing_type_leaves_the_others(engine, monkeypatch):
    def broken(*a, **k):
        raise OSError("no disk")

    monkeypatch.setattr(ingest, "circulars", broken)
    found = {r["doc_type"]: r for r in ingest.everything(engine.run, SITE, limit=1).collect()}
    assert found["tsutatsu"]["error"] == "OSError: no disk" and found["tax-answer"]["total"] == 1
    assert cli.failed("everything", json.loads('{"doc_type": "tsutatsu", "error": "x"}')) and not cli.failed("everything", {"warn": False})


def test_runs_have_an_age(engine):
    assert {r["days_ago"] for r in cli.execute(engine, cli.arguments(["runs"])).collect()} == {0}


def test_canaries(engine, spark):
    found = cli.execute(engine, cli.arguments(["canary", "--site", SITE]))
    rows = {r["name"]: r for r in found.collect()}
    assert len(rows) == 9 and {n for n, r in rows.items() if r["ok"]} == {"tsutatsu-shohi", "tax-answer", "qa-jirei"}
    assert rows["jimu-unei"]["reason"] == "nothing found" and rows["kaisei"]["reason"] == "status 404"
    assert ingest.canary_counts(found).first().asDict() == {"ok": 3, "failed": 6}
    index = spark.createDataFrame([("a", "tax-answer", f"{SITE}/taxes/shiraberu/taxanswer/code/")], "name string, kind string, url string")
    assert ingest.canaries(engine.run, index).first()["ok"]
    assert cli.failed("canary", {"ok": False}) and not cli.failed("canary", {"ok": True})
    with pytest.raises(ValueError):
        cli.execute(engine, cli.arguments(["canary"]))


def test_missed_clauses_list_what_there_is(engine, spark):
    asked = spark.createDataFrame([("消基通", "9-9-9"), ("消基通", "1-1-2"), ("なし", "1-1-1")], "name string, clause string")
    rows = engine.available_clauses_on_miss(asked).collect()
    assert {(r["name"], r["asked"], r["clause_number"]) for r in rows} == {("消費税法基本通達", "9-9-9", "1-1-2"), ("消費税法基本通達", "9-9-9", "1-1-10")}
    assert engine.available_clauses_on_miss(asked, limit=1).count() == 1


def test_live_clauses_are_read_and_kept(spark, tmp_path):
    calls = []

    def counted(url, timeout):
        (tmp_path / "calls").mkdir(exist_ok=True)
        (tmp_path / "calls" / url.rsplit("/", 1)[1]).touch()
        return get(url, timeout)

    e = Engine(spark, f"file://{tmp_path}/store", "2026-05-09T00:00:00Z", counted, fetch.FetchParams(retries=0, interval=0.0))
    heads = plan.circulars(spark, SITE).select(F.xxhash64("formal_name").alias("id"), "formal_name", "abbr", F.col("url").alias("source_root_url"))
    e.store["circular"].merge(heads)
    asked = spark.createDataFrame([("消基通", "1－1－10"), ("消基通", "1-1-11"), ("所基通", "1-1-1"), ("消基通", "x")], "name string, clause string")
    assert e.get_clauses(asked).filter("source IS NOT NULL").count() == 0 and not calls
    found = {(r["name"], r["clause"]): (r["source"], r["title"]) for r in e.get_clauses(asked, live=True).collect()}
    assert found == {("消費税法基本通達", "1－1－10"): ("live", "範囲"), ("消費税法基本通達", "1-1-11"): (None, None), ("所得税基本通達", "1-1-1"): (None, None), ("消費税法基本通達", "x"): (None, None)}
    assert {r["clause_number"]: r["source"] for r in e.get_clauses(asked).filter("source IS NOT NULL").collect()} == {"1-1-10": "db"}


def test_markdown(engine):
    case = engine.document_markdown(engine.get_qa("shohi", "2", "19")).first()["markdown"]
    assert case.startswith("# 家屋の事例\n\n## 【照会要旨】\n\n問い\n\n## 【回答要旨】\n\n答え一\n\n答え二\n") and "関係法令通達" not in case
    answer = engine.document_markdown(engine.get_tax_answer("6101")).first()["markdown"]
    assert answer.startswith("# No.6101 消費の仕組み\n\n法令時点: 2020-04-01\n対象税目: shohi\n") and "## 概要\n\n一つ目\n\n二つ目\n\n## 根拠\n\n法\n" in answer and "出典: https" in answer
    page = engine.section_markdown("消費税法基本通達", 1, 1).first()["markdown"]
    assert page.index("1-1-2（意義）") < page.index("1-1-10（範囲）") and "> 細目" in page and page.startswith("# ")
    assert engine.section_markdown("消費税法基本通達", 7, 7).count() == 0
    hits = engine.hits_markdown(engine.search_tax_answers("一つ目")).first()["markdown"]
    assert hits.startswith("- [消費の仕組み](https://example.org/") and "<b>一つ目</b>" in hits


def test_batch_search_shows_snippets(engine, spark):
    r = engine.search_many(spark.createDataFrame([(1, "一つ目"), (2, "なにも無し")], "query_id int, keyword string")).collect()
    assert [(x["query_id"], x["key"]) for x in r] == [(1, "tax-answer/6101")] and "<b>一つ目</b>" in r[0]["snippet"]


def test_small_functions(spark):
    one = spark.createDataFrame([("印基通", "2026-03-01T00:00:00Z", [("別紙", "u", None, None), ("x", "v", None, None)])], f"a string, t string, p array<{pdf.PDF}>")
    r = one.select(urls.resolve_abbreviation(F.col("a")).alias("r"), urls.abbreviation(F.lit("印紙税法基本通達")).alias("s"), urls.abbreviation(F.lit("民法")).alias("n"),
                   quality.freshness_of(F.col("t"), F.lit("2026-05-01T00:00:00Z"), "again").alias("f"), pdf.noted_hints(F.col("p")).alias("h"), text.sections(F.lit("t\n\nbody")).alias("none"),
                   text.sections(F.lit("t\n\n【a】\nx\ny\n\n【b】\nz")).alias("some"), text.sections(F.lit(None).cast("string")).alias("null")).first()
    assert (r["r"]["formal_name"], r["r"]["in_scope"], r["s"], r["n"]) == ("印紙税法基本通達", False, "印基通", "民法")
    assert (r["f"]["staleness"], r["f"]["days_since"]) == ("outdated", 61) and r["f"]["warning"].endswith("again")
    assert [h["kind"] for h in r["h"]] == ["attachment", "unknown"] and all(h["note"] for h in r["h"])
    assert r["none"] == [] and r["null"] == [] and [(s["heading"], s["paragraphs"]) for s in r["some"]] == [("a", ["x", "y"]), ("b", ["z"])]
