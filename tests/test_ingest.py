import pytest
from pyspark.sql import functions as F

from lexispark import cli
from lexispark.operators import ingest, pages
from lexispark.plans.api import Engine
from lexispark.sources import fetch, store
from lexispark.streaming import ingest as streaming

BASE = "https://tax.example"
SECTION = """<html><head><title>第1節 区分者|site</title></head><body><div id="x"><a href="/out.htm">out</a></div>
<div class="imp-cnt-tsutatsu" id="bodyArea"><ol class="breadcrumb"><li>nav</li></ol><p class="center">第1章　資産</p>
<div class="page-header"><h1>第1節　資産{n}の区分</h1></div>
<h2>（区分）</h2><p class="indent1"><strong>1－{n}－1</strong>　本文一<br>二行目</p><p class="indent2">(1) 細目</p><p class="indent3">イ 細細目</p><p style="margin-left:1em">（注）</p>
<h2>（付き）</h2><p>前置き</p><p class="indent1">1－{n}－1の2　本文二</p>
<h2>番号なし</h2><p class="indent1">本文</p>
<h2>境界</h2><p class="indent1">1－{n}－2 <b>最後</b><div class="page-header"><h1>別の節</h1></div><p class="indent1">1－9－9 別</p></div></body></html>"""
TOC = """<div id="bodyArea"><p><strong>第1章　総則</strong></p><p class="indent2">第1節　<a href="01/01.htm#a">通則</a></p><p class="indent2">第2節 <a href="01/02.htm">雑則</a> <a href="01/02.htm#b">again</a></p>
<p><strong>第2章 空</strong></p><p><strong>第3章　末</strong></p><p class="indent2">第1節　節</p><p class="indent3">第1款　<a href="03/01.htm">款</a></p></div>"""
REVISION = """<div class="imp-cnt-tsutatsu" id="bodyArea"><div class="page-header"><h1>改正について（法令解釈通達）</h1></div><p>課個2-1<br>平成１７年１１月９日</p><p>税務署長 殿</p><p>国税庁長官</p>
<p>本文　課税売上</p><p><a href="pdf/a.pdf">新旧対照表（PDF/3,081KB）</a><a href="pdf/a.pdf">again</a><a href="b.pdf?x">別紙</a></p><p class="page-top-link">x</p><p>ページの先頭へ戻る</p></div>"""
INDEX = """<div id="bodyArea"><ul><li><a href="/law/tsutatsu/kihon/shohi/kaisei/1/index.htm#t">一（平成30年1月2日）</a></li><li><a href="/law/tsutatsu/kihon/shohi/kaisei/1/index.htm">dup</a></li><li><a href="/law/tsutatsu/kihon/shohi/kaisei/2/index.htm">二</a></li><li><a href="/other.htm">no</a></li></ul></div>"""
ANSWER = """<div class="imp-cnt" id="bodyArea"><div class="page-header"><h1>No.7355 契約書と印紙</h1></div><p>[平成26年8月3日現在法令等]</p><h2>対象税目</h2><p>消費税</p><h2>概要</h2><p>一</p><ul><li>二</li></ul><h2>サイトマップ</h2><p>x</p></div>"""
QA = """<div id="bodyArea" class="imp-cnt-tsutatsu"><h1>事例</h1><h2>【照会要旨】</h2><p>問</p><h2>【回答要旨】</h2><p>答一</p><p>答二</p><h2>【関係法令通達】</h2><p>法</p><h2>注</h2><p>x</p></div>"""


def site():
    at = {
        "/toc.htm": TOC, "/01/01.htm": SECTION.replace("{n}", "1"), "/01/02.htm": SECTION.replace("{n}", "2"), "/index.htm": INDEX,
        "/law/tsutatsu/kihon/shohi/kaisei/1/index.htm": REVISION, "/law/tsutatsu/kihon/shohi/kaisei/2/index.htm": "<p>no body</p>",
    }

    def get(url, timeout):
        body = at.get(url.removeprefix(BASE))
        return (200, "text/html; charset=Shift_JIS", body.encode("cp932")) if body else (404, "", b"")

    return get


def parsed(spark, html, url=f"{BASE}/x/toc.htm"):
    return pages.parse(spark.createDataFrame([(url, html, None)], "url string, html string, fetched_at timestamp"))


def test_section_page(spark):
    rows = pages.section_clauses(parsed(spark, SECTION.replace("{n}", "4"))).orderBy("pos").collect()
    assert [r["clause_number"] for r in rows] == ["1-4-1", "1-4-1の2", "1-4-2"]
    assert rows[0]["title"] == "区分" and rows[0]["chapter_title"] == "第1章 資産" and rows[0]["section_title"] == "第1節 資産4の区分"
    assert [(p["indent"], p["text"]) for p in rows[0]["paragraphs"]] == [(1, "本文一\n二行目"), (2, "(1) 細目"), (3, "イ 細細目"), (2, "（注）")]
    assert rows[2]["full_text"] == "境界\n最後"


def test_contents(spark):
    rows = pages.contents(parsed(spark, TOC), F.lit("shohi")).orderBy("chapter_number", "section_number").collect()
    assert [(r["chapter_number"], r["chapter_title"], r["section_number"], r["section_title"], r["section_url"].removeprefix(BASE)) for r in rows] == [
        (1, "第1章 総則", 1, "第1節 通則", "/x/01/01.htm"), (1, "第1章 総則", 2, "第2節 雑則 again", "/x/01/02.htm"), (2, "第3章 末", 1, "第1款 款", "/x/03/01.htm"),
    ]
    assert rows[2]["subsection"] and rows[2]["of_section"] == "第1節 節"
    part = '<div id="bodyArea"><h2>第1編 総則</h2><h3>第1章 通則</h3><ul><li><a href="a.htm">A</a></li></ul><h2>第2編 各論</h2><h3>第1章 所得</h3><ul><li><a href="b.htm">B</a><li><a href="b.htm#x">B2</a></ul></div>'
    got = pages.contents(parsed(spark, part), F.lit("shotoku")).orderBy("chapter_number").collect()
    assert [(r["chapter_title"], r["section_title"]) for r in got] == [("第1編 総則 第1章 通則", "A"), ("第2編 各論 第1章 所得", "B")]
    law = '<div id="bodyArea"><h2>第1章 空</h2><h2>第1章の2 法</h2><p><a href="a.htm">A</a></p><h2>附則</h2><p><a href="z.htm">Z</a></p></div>'
    got = pages.contents(parsed(spark, law), F.lit("hojin")).orderBy("chapter_number").collect()
    assert [(r["chapter_number"], r["chapter_title"]) for r in got] == [(1, "第1章の2 法"), (2, "附則")]
    heirs = '<div id="bodyArea"><p align="center">第1章 税</p><p class="center">第1節 人</p><p class="indent1">第1条関係</p><p class="indent2"><a href="a.htm">イ</a><a href="b.htm">ロ</a></p><p><strong>共通関係</strong></p><p class="indent2"><a href="a.htm#2">イ</a><a href="c.htm">ハ</a></p></div>'
    got = pages.contents(parsed(spark, heirs), F.lit("sozoku")).orderBy("section_number").collect()
    assert [(r["section_number"], r["section_title"]) for r in got] == [(1, "第1節 人 / 第1条関係 / イ"), (2, "第1節 人 / 第1条関係 / ロ"), (3, "第1節 人 / 共通関係 / ハ")]


def test_document_pages(spark):
    r = pages.document_pages(parsed(spark, REVISION, f"{BASE}/law/tsutatsu/kihon/shohi/kaisei/r88/index.htm"), "kaisei").first()
    assert (r["doc_id"], r["taxonomy"], r["issued_at"], r["issuer"]) == ("r88", "shohi", "2005-11-09", "税務署長 殿\n国税庁長官")
    assert [(p["title"], p["url"].rsplit("/", 1)[1], p["size_kb"], p["kind"]) for p in r["attached_pdfs"]] == [("新旧対照表（PDF/3,081KB）", "a.pdf", 3081, "comparison"), ("別紙", "b.pdf?x", None, "attachment")]
    assert "ページの先頭" not in r["full_text"] and r["error"] is None
    assert pages.document_pages(parsed(spark, "<p>x"), "kaisei").first()["error"] == "no body element"
    t = pages.tax_answers(parsed(spark, ANSWER, f"{BASE}/taxanswer/inshi/7355.htm")).first()
    assert (t["doc_id"], t["title"], t["tax_category"], t["issued_at"], [s["heading"] for s in t["sections"]]) == ("7355", "契約書と印紙", "消費税", "2014-08-03", ["概要"])
    assert t["sections"][0]["paragraphs"] == ["一", "二"]
    q = pages.qa_cases(parsed(spark, QA, f"{BASE}/shitsugi/shohi/01/02.htm")).first()
    assert (q["doc_id"], q["question"], q["answer"], q["related_laws"]) == ("shohi/01/02", ["問"], ["答一", "答二"], ["法"])
    assert q["full_text"].startswith("事例\n\n【照会要旨】\n問")


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}", "2026-05-01T00:00:00Z", site(), fetch.FetchParams(retries=0, interval=0.0))


def test_documents_end_to_end(spark, engine):
    index = spark.createDataFrame([(f"{BASE}/index.htm",)], "url string")
    first = ingest.documents(engine.run, "kaisei", index).first()
    assert (first["total"], first["failed"], first["new_docs"], first["warn"]) == (2, 1, 1, False)
    again = ingest.documents(engine.run, "kaisei", index).first()
    assert (again["new_docs"], again["updated_docs"], again["orphaned_docs"]) == (0, 0, 0)
    assert engine.store.read("document").count() == 1 and engine.store.read("run_history").count() == 2
    hit = engine.search_revisions("課税売上").first()
    assert hit["doc_id"] == "1" and hit["freshness"]["staleness"] == "fresh" and hit["binding"]["binds_tax_office"]
    assert engine.search_documents("課税売上", "kaisei", has_pdf=False).count() == 0
    got = engine.get_revision("1")
    assert got.first()["source"] == "db" and "📎 別紙・別表 | 別紙 | —" in engine.document_markdown(got).first()["markdown"]
    assert [h["kind"] for h in engine.inspect_pdfs("kaisei", "1").first()["hints"]] == ["comparison", "attachment"]
    assert engine.available_documents("kaisei").first()["doc_id"] == "1"
    assert engine.search_many(spark.createDataFrame([(1, "課税売上")], "query_id int, keyword string")).first()["key"] == "kaisei/1"
    with pytest.raises(ValueError):
        engine.get_tax_answer("8001")


def test_circular_end_to_end(spark, engine):
    a = cli.arguments(["circular", "消費税法基本通達", "消基通", f"{BASE}/toc.htm"])
    r = cli.execute(engine, a).first()
    assert (r["doc_type"], r["total"], r["failed"], r["new_docs"]) == ("tsutatsu-shohi", 3, 1, 6)
    asked = spark.createDataFrame([("消基通", "１－1－1の２"), ("消費税法基本通達", "9-9-9")], "name string, clause string")
    found = {x["clause"]: x for x in engine.get_clauses(asked).collect()}
    assert found["１－1－1の２"]["title"] == "付き" and found["9-9-9"]["source"] is None
    assert engine.search_circulars("本文一").count() == 2 and engine.available_clauses("消費税法基本通達").count() == 6
    assert engine.stale_sections(1).count() == 0
    assert cli.execute(engine, cli.arguments(["runs"])).first()["total"] == 3
    ok = {x["name"]: x["ok"] for x in cli.execute(engine, cli.arguments(["canary", f"a,circular,{BASE}/01/01.htm", f"b,document,{BASE}/none.htm"])).collect()}
    assert ok == {"a": True, "b": False}


def test_failed_pages_keep_their_clauses(spark, tmp_path):
    pages_ = site()
    down, contents = set(), [TOC]

    def get(url, timeout):
        path = url.removeprefix(BASE)
        if path in down:
            return (503, "", b"")
        return (200, "text/html; charset=Shift_JIS", contents[0].encode("cp932")) if path == "/toc.htm" else pages_(url, timeout)

    e = Engine(spark, f"file://{tmp_path}", "2026-05-01T00:00:00Z", get, fetch.FetchParams(retries=0, interval=0.0))
    toc = spark.createDataFrame([("消費税法基本通達", "消基通", f"{BASE}/toc.htm")], "formal_name string, abbr string, url string")
    numbers = lambda: sorted(r["clause_number"] for r in e.store.read("clause").collect())
    ingest.circulars(e.run, toc)
    everything = numbers()
    assert len(everything) == 6
    down.add("/01/02.htm")
    assert ingest.circulars(e.run, toc).first()["failed"] == 2 and numbers() == everything
    down.add("/toc.htm")
    ingest.circulars(e.run, toc)
    assert numbers() == everything
    down.discard("/toc.htm")
    contents[0] = TOC.replace("01/02.htm", "01/01.htm")  # the contents drop a page
    ingest.circulars(e.run, toc)
    assert numbers() == [n for n in everything if n.startswith("1-1-")]
    assert ingest.circulars(e.run, toc.filter("false")).count() == 0


def test_allow_list_and_live_documents(spark, tmp_path):
    links = '<div id="bodyArea"><ul><li><a href="/taxes/shiraberu/taxanswer/inshi/7355.htm">7355 a</a></li><li><a href="/taxes/shiraberu/taxanswer/gensen/7356.htm">7356 b</a></li></ul></div>'
    at = {"/answers.htm": links, "/taxes/shiraberu/taxanswer/inshi/7355.htm": ANSWER, "/taxes/shiraberu/taxanswer/gensen/7356.htm": ANSWER.replace("7355", "7356"), "/law/shitsugi/shohi/03/07.htm": QA}
    get = lambda url, timeout: (200, "text/html; charset=utf-8", at[url.removeprefix(BASE)].encode()) if url.removeprefix(BASE) in at else (404, "", b"")
    e = Engine(spark, f"file://{tmp_path}", "2026-05-01T00:00:00Z", get, fetch.FetchParams(retries=0, interval=0.0))
    index = spark.createDataFrame([(f"{BASE}/answers.htm",)], "url string")
    assert ingest.documents(e.run, "tax-answer", index, taxonomies=["gensen"]).first()["total"] == 1
    assert [r["doc_id"] for r in e.store.read("document").collect()] == ["7356"]
    assert e.get_tax_answer("7355").count() == 0
    asked = spark.createDataFrame([("tax-answer", "7355"), ("tax-answer", "7356")], "doc_type string, doc_id string")
    assert [(r["asked"], r["doc_id"]) for r in e.available_on_miss(asked).collect()] == [("7355", "7356")]
    live = e.get_tax_answer("7355", site=BASE)
    assert live.first()["source"] == "live" and "契約書と印紙" in e.document_markdown(live).first()["markdown"]
    assert e.get_tax_answer("7355").first()["source"] == "db"
    assert e.get_qa("shohi", "3", "7", site=BASE).first()["doc_id"] == "shohi/03/07"
    assert e.get_qa("shohi", "3", "9", site=BASE).count() == 0


def test_retry_and_charset(spark):
    seen = []

    def flaky(url, timeout):
        seen.append(url)
        return (503, "", b"") if len(seen) < 3 else (200, "text/html", b"ok")

    waits = []
    assert fetch.fetch_one("u", flaky, fetch.FetchParams(backoff=1.0), waits.append)[:4] == (b"ok", "text/html", 200, 3) and waits == [1.0, 2.0]
    assert fetch.fetch_one("u", lambda u, t: (404, "", b""), fetch.FetchParams())[2:4] == (404, 1)
    rows = [("text/html; charset=UTF8", ""), ("", "<meta charset='x-sjis'>"), (None, "")]
    got = spark.createDataFrame(rows, "c string, h string").select(pages.detect_charset(F.col("c"), F.col("h")).alias("x")).collect()
    assert [r["x"] for r in got] == ["utf-8", "shift_jis", "shift_jis"]


def test_store_and_history(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    rows = [("kaisei", f"2024-01-{i:02d} 00:00:00", i) for i in range(1, 16)]
    runs = spark.createDataFrame(rows, "doc_type string, at string, total long").selectExpr(
        "doc_type", "cast(at AS timestamp) AS ran_at", "total", "total AS fetched", "0L AS failed", "0L AS new_docs", "0L AS updated_docs", "0L AS orphaned_docs", "0L AS moved_docs", "0D AS fail_rate", "1L AS duration_ms"
    )
    s.append_run(runs)
    assert sorted(r["total"] for r in s.read("run_history").collect()) == list(range(4, 16))
    store.write_history_json(s.read("run_history"), f"file://{tmp_path}/json")
    assert store.read_history_json(spark, f"file://{tmp_path}/json").count() == 12
    (tmp_path / "bad.json").write_text("{broken")
    assert store.read_history_json(spark, f"file://{tmp_path}/bad.json").count() == 0
    one = spark.createDataFrame([(1, "a", "x", "u"), (1, "a", "y", "u")], "id long, formal_name string, abbr string, source_root_url string")
    for _ in range(4):
        s["circular"].merge(one)
    assert s.read("circular").count() == 1 and len(s["circular"].versions()) == 4
    s.clear()
    assert s.read("circular").count() == 0


def test_streamed_pages(spark, tmp_path):
    html = [(f"{BASE}/law/tsutatsu/kihon/shohi/kaisei/{i}/index.htm", REVISION, "2026-04-02") for i in range(3)] + [("x", "<p>", "2026-04-02")]
    spark.createDataFrame(html, "url string, html string, d string").selectExpr("url", "html", "cast(d AS timestamp) AS fetched_at").write.parquet(f"file://{tmp_path}/in")
    s = store.Store(spark, f"file://{tmp_path}/store")
    raw = streaming.raw_pages(spark, f"file://{tmp_path}/in")
    streaming.merge_pages(raw, s["document"], "kaisei", f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r["doc_id"] for r in s.read("document").collect()) == ["0", "1", "2"]
    q = streaming.fetch_rates(raw).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["host"], r["pages"]) for r in spark.table("rates").collect()} == {("tax.example", 3), ("", 1)}
