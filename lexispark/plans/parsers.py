"""Registered queries of the page parsers and the small text functions, each with its DuckDB SQL.

The test tables hold no regulation pages, so pages are written from their rows: a
template per kind of page, filled in with a row's columns.  The SQL never sees a
page; it states what the parser has to find in it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pdf, text, urls
from ..operators import pages
from .catalogue import ORACLES, QUERIES, query, table  # noqa: F401 - the queries join the catalogue's

SITE = "https://tax.example"


def filled(template: str) -> Column:
    """The template with SQL expressions in braces replaced by their values."""
    parts = re.split(r"\{(.+?)\}", template)
    return F.concat(*[F.expr(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def written(df: DataFrame, key: str, url: Column, html: Column) -> DataFrame:
    """A parsed page for each row."""
    return pages.parse(pages.dealt(df, key).select(key, url.alias("url"), html.alias("html"), F.lit(None).cast("timestamp").alias("fetched_at")))


SECTION = """<html><head><title>頁</title></head><body><div id="bodyArea"><p class="center">第{c_custkey % 7 + 1}章　総目</p>
<div class="page-header"><h1>第{c_custkey % 3 + 1}節 {c_name}</h1></div><h2>（見出し{c_custkey}）</h2><p>前文</p>
<p class="indent1"><strong>{c_custkey % 7 + 1}－{c_custkey % 3 + 1}－{c_custkey}</strong>　{c_mktsegment}</p><p class="indent2">(1) 甲</p><p class="indent3">乙</p>
<h2>無番号</h2><p class="indent1">文</p><h2>末</h2><p class="indent1">{c_custkey}－1－1の2　末文</p></div></body></html>"""


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, '第' || (c_custkey % 7 + 1) || '章 総目' AS chapter_title, '第' || (c_custkey % 3 + 1) || '節 ' || c_name AS section_title FROM customer)
SELECT c_custkey, 0 AS pos, (c_custkey % 7 + 1) || '-' || (c_custkey % 3 + 1) || '-' || c_custkey AS clause_number, '見出し' || c_custkey AS title, chapter_title, section_title,
  '見出し' || c_custkey || chr(10) || c_mktsegment || chr(10) || '(1) 甲' || chr(10) || '乙' AS full_text, '1,2,3' AS indents FROM c
UNION ALL SELECT c_custkey, 2, c_custkey || '-1-1の2', '末', chapter_title, section_title, '末' || chr(10) || '末文', '1' FROM c""")
def parse_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = written(table(spark, sf_dir, "customer"), "c_custkey", filled(SITE + "/{c_custkey}/01.htm"), filled(SECTION))
    indents = F.array_join(F.transform("paragraphs", lambda p: p["indent"].cast("string")), ",")
    return pages.section_clauses(parsed).select("c_custkey", "pos", "clause_number", "title", "chapter_title", "section_title", "full_text", indents.alias("indents"))


CONTENTS = {
    "消費税法基本通達": """<div id="bodyArea"><p><strong>第4章　資産</strong></p><p class="indent2">第1節　<a href="a/1.htm#x">土地{s_suppkey}</a></p>
<p class="indent2">第2節 <a href="a/2.htm">建物</a></p><p><strong>第5章 空</strong></p><p><strong>第6章　負債</strong></p><p class="indent2">第3節　長期</p><p class="indent3">第1款　<a href="c/1.htm">借入</a></p></div>""",
    "所得税基本通達": """<div id="bodyArea"><h2>第1編 甲</h2><h3>第2章 乙</h3><ul><li><a href="a.htm">丙{s_suppkey}</a></li></ul>
<h3>第3章 丁</h3><ul><li><a href="b.htm">戊</a></li><li><a href="b.htm#x">己</a></li></ul></div>""",
    "法人税基本通達": """<div id="bodyArea"><h2>第1章 空</h2><h2>第2章の3 法</h2><p><a href="a.htm">庚{s_suppkey}</a></p><h2>附則</h2><p><a href="z.htm">辛</a></p></div>""",
    "相続税法基本通達": """<div id="bodyArea"><p class="center">第5章 税</p><p class="center">第1節 人</p><p class="indent1">第2条関係</p>
<p class="indent2"><a href="a.htm">壬{s_suppkey}</a><a href="b.htm">癸</a></p><p><strong>共通関係</strong></p><p class="indent2"><a href="a.htm#2">壬</a><a href="c.htm">子</a></p></div>""",
}


@query("""WITH e(i, style, chapter_number, chapter_title, section_number, head, tail, subsection, of_section, path) AS (VALUES
  (0, 'shohi', 1, '第4章 資産', 1, '第1節 土地', true, false, NULL, 'a/1.htm'), (0, 'shohi', 1, '第4章 資産', 2, '第2節 建物', false, false, NULL, 'a/2.htm'),
  (0, 'shohi', 2, '第6章 負債', 1, '第1款 借入', false, true, '第3節 長期', 'c/1.htm'),
  (1, 'shotoku', 1, '第1編 甲 第2章 乙', 1, '丙', true, false, NULL, 'a.htm'), (1, 'shotoku', 2, '第1編 甲 第3章 丁', 1, '戊', false, false, NULL, 'b.htm'),
  (2, 'hojin', 1, '第2章の3 法', 1, '庚', true, false, NULL, 'a.htm'), (2, 'hojin', 2, '附則', 1, '辛', false, false, NULL, 'z.htm'),
  (3, 'sozoku', 1, '第5章 税', 1, '第1節 人 / 第2条関係 / 壬', true, false, NULL, 'a.htm'), (3, 'sozoku', 1, '第5章 税', 2, '第1節 人 / 第2条関係 / 癸', false, false, NULL, 'b.htm'),
  (3, 'sozoku', 1, '第5章 税', 3, '第1節 人 / 共通関係 / 子', false, false, NULL, 'c.htm'))
SELECT 'https://tax.example/' || s_suppkey || '/toc.htm' AS url, style, chapter_number, chapter_title, section_number, head || CASE WHEN tail THEN s_suppkey::VARCHAR ELSE '' END AS section_title,
  subsection, of_section, 'https://tax.example/' || s_suppkey || '/' || path AS section_url FROM supplier JOIN e ON i = s_suppkey % 4""")
def parse_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = enumerate(CONTENTS.items())
    one = lambda i, name, html: pages.contents(
        written(table(spark, sf_dir, "supplier").filter(F.col("s_suppkey") % 4 == i), "s_suppkey", filled(SITE + "/{s_suppkey}/toc.htm"), filled(html)), urls.toc_style(F.lit(name))
    )
    return reduce(DataFrame.union, [one(i, name, html) for i, (name, html) in kinds])


NOTICE = """<div id="bodyArea"><div class="page-header"><h1>通知{c_custkey}（{c_mktsegment}）</h1></div><p>課{c_custkey}<br>令和{c_nationkey + 1}年{c_custkey % 12 + 1}月{c_custkey % 28 + 1}日</p><p>{c_name}署長 殿</p>
<h2>第一</h2><p>本文　{c_name}</p><p><a href="../f{c_custkey}.pdf">新旧対照表（PDF/{c_custkey}KB）</a><a href="../f{c_custkey}.pdf">再</a><a href="b.PDF?x">別紙</a></p><p>ページの先頭へ戻る</p></div>"""
NOTICE_URLS = {"kaisei": "/law/tsutatsu/kihon/hojin/kaisei/r{c_custkey}/", "jimu-unei": "/law/jimu-unei/inshi/g{c_custkey}/", "bunshokaitou": "/about/organization/osaka/bunshokaito/sozoku/q{c_custkey}/"}


@query("""WITH k(doc_type, prefix, taxonomy, folder, own, headed) AS (VALUES ('kaisei', 'r', 'hojin', '/law/tsutatsu/kihon/hojin/kaisei/', 'r', false),
  ('jimu-unei', 'inshi/g', 'inshi', '/law/jimu-unei/inshi/', 'g', true), ('bunshokaitou', 'osaka/sozoku/q', 'sozoku', '/about/organization/osaka/bunshokaito/sozoku/', 'q', true)),
d AS (SELECT doc_type, prefix || c_custkey AS doc_id, taxonomy, '通知' || c_custkey || '（' || c_mktsegment || '）' AS title, printf('%04d-%02d-%02d', (2019 + c_nationkey)::INT, (c_custkey % 12 + 1)::INT, (c_custkey % 28 + 1)::INT) AS issued_at,
  c_name || '署長 殿' AS issuer,
  '課' || c_custkey || ' 令和' || (c_nationkey + 1) || '年' || (c_custkey % 12 + 1) || '月' || (c_custkey % 28 + 1) || '日' || chr(10) || c_name || '署長 殿' || chr(10) || CASE WHEN headed THEN '【第一】' || chr(10) ELSE '' END
    || '本文 ' || c_name || chr(10) || '新旧対照表（PDF/' || c_custkey || 'KB）再別紙' AS full_text,
  'https://tax.example' || folder || 'f' || c_custkey || '.pdf|' || c_custkey || '|comparison|新旧対照表（PDF/' || c_custkey || 'KB）;https://tax.example' || folder || own || c_custkey || '/b.PDF?x|-|attachment|別紙' AS pdfs FROM customer, k)
SELECT *, sha1(doc_type || chr(10) || doc_id || chr(10) || title || chr(10) || full_text) AS content_hash FROM d""")
def parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda kind, path: pages.document_pages(written(table(spark, sf_dir, "customer"), "c_custkey", filled(SITE + path + "index.htm"), filled(NOTICE)), kind)
    rows = reduce(DataFrame.union, [one(kind, path) for kind, path in NOTICE_URLS.items()])
    files = F.array_join(F.transform("attached_pdfs", lambda p: F.concat_ws("|", p["url"], F.coalesce(p["size_kb"].cast("string"), F.lit("-")), p["kind"], p["title"])), ";")
    return rows.select("doc_type", "doc_id", "taxonomy", "title", "issued_at", "issuer", "full_text", files.alias("pdfs"), "content_hash")


INDEX = """<div id="bodyArea"><ul><li><a href="/law/tsutatsu/kihon/shohi/kaisei/{s_suppkey}/index.htm#t">改{s_suppkey}（平成{s_nationkey + 1}年2月3日）</a></li><li><a href="/law/tsutatsu/kihon/shohi/kaisei/{s_suppkey}/index.htm">再</a></li>
<li><a href="/law/jimu-unei/hojin/{s_suppkey}/01.htm">運{s_suppkey}</a></li><li><a href="/law/bunshokaito/shotoku/01.htm">回{s_suppkey}</a><a href="/law/bunshokaito/shotoku/02.htm">回二</a></li>
<li><a href="/law/bunshokaito/inshi/{s_suppkey}/index.htm">答{s_suppkey}</a></li><li><a href="../taxanswer/shohi/{6000 + s_suppkey}.htm">タ{s_suppkey}</a></li><li><a href="/shitsugi/hojin/01/{s_suppkey}.htm"> 質　{s_suppkey} </a></li><li><a href="/other.htm">無</a></li></ul></div>"""


@query("""WITH k(kind, a, b, head, dated) AS (VALUES ('kaisei', '/law/tsutatsu/kihon/shohi/kaisei/', '/index.htm', '改', true), ('jimu-unei', '/law/jimu-unei/hojin/', '/01.htm', '運', false),
  ('bunshokaitou-main', '/law/bunshokaito/shotoku/01.htm', NULL, '回', false), ('bunshokaitou', '/law/bunshokaito/inshi/', '/index.htm', '答', false),
  ('tax-answer', '/taxanswer/shohi/', '.htm', 'タ', false), ('qa-jirei', '/shitsugi/hojin/01/', '.htm', '質 ', false))
SELECT kind, 'https://tax.example/' || s_suppkey || '/index.htm' AS page_url, 'https://tax.example' || a || coalesce(CASE WHEN kind = 'tax-answer' THEN 6000 + s_suppkey ELSE s_suppkey END || b, '') AS url,
  head || s_suppkey || CASE WHEN dated THEN '（平成' || (s_nationkey + 1) || '年2月3日）' ELSE '' END AS title, CASE WHEN dated THEN (1989 + s_nationkey) || '-02-03' END AS issued_at FROM supplier, k""")
def parse_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = written(table(spark, sf_dir, "supplier"), "s_suppkey", filled(SITE + "/{s_suppkey}/index.htm"), filled(INDEX))
    rows = [pages.index_links(parsed, kind).select(F.lit(kind).alias("kind"), "page_url", "url", "title", "issued_at") for kind in pages.INDEX_LINKS]
    return reduce(DataFrame.union, rows)


ANSWER = """<div id="bodyArea"><div class="page-header"><h1>No.{p_partkey} {p_name}</h1></div><p>[平成{p_size}年4月1日現在法令等]</p><h2>対象税目</h2><p>{p_brand}</p>
<h2>要点</h2><p>甲{p_partkey}</p><ul><li>乙</li></ul><h2>サイトマップ</h2><p>x</p></div>"""


@query("""SELECT p_partkey::VARCHAR AS doc_id, 'inshi' AS taxonomy, p_name AS title, printf('%04d-04-01', (1988 + p_size)::INT) AS issued_at, '平成' || p_size || '年4月1日現在法令等' AS effective_date, p_brand AS tax_category,
  '要点:甲' || p_partkey || ',乙' AS sections, p_name || chr(10) || chr(10) || '【要点】' || chr(10) || '甲' || p_partkey || chr(10) || '乙' AS full_text FROM part""")
def parse_tax_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.tax_answers(written(table(spark, sf_dir, "part"), "p_partkey", filled(SITE + "/taxanswer/inshi/{p_partkey}.htm"), filled(ANSWER)))
    sections = F.array_join(F.transform("sections", lambda s: F.concat(s["heading"], F.lit(":"), F.array_join(s["paragraphs"], ","))), ";")
    return rows.select("doc_id", "taxonomy", "title", "issued_at", "effective_date", "tax_category", sections.alias("sections"), "full_text")


CASE = """<div id="bodyArea"><h1>{p_type}の取扱い</h1><h2>【照会要旨】</h2><p>問{p_partkey}</p><h2>【回答要旨】</h2><p>答{p_partkey}</p><p>答二</p><h2>【関係法令通達】</h2><p>{p_brand}条</p><h2>注記</h2><p>x</p></div>"""


@query("""SELECT 'hojin/' || (p_partkey % 9 + 1) || '/' || p_partkey AS doc_id, 'hojin' AS taxonomy, (p_partkey % 9 + 1)::VARCHAR AS category, p_partkey::VARCHAR AS number, p_type || 'の取扱い' AS title,
  ['問' || p_partkey] AS question, ['答' || p_partkey, '答二'] AS answer, [p_brand || '条'] AS related_laws,
  p_type || 'の取扱い' || chr(10) || chr(10) || '【照会要旨】' || chr(10) || '問' || p_partkey || chr(10) || chr(10) || '【回答要旨】' || chr(10) || '答' || p_partkey || chr(10) || '答二' || chr(10) || chr(10)
    || '【関係法令通達】' || chr(10) || p_brand || '条' AS full_text FROM part""")
def parse_qa_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.qa_cases(written(table(spark, sf_dir, "part"), "p_partkey", filled(SITE + "/shitsugi/hojin/{p_partkey % 9 + 1}/{p_partkey}.htm"), filled(CASE)))
    return rows.select("doc_id", "taxonomy", "category", "number", "title", "question", "answer", "related_laws", "full_text")


# ---- small text functions -----------------------------------------------------------------------


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN '(' || p_name || ') 外' ELSE p_name END AS bare FROM part")
def strip_parens(spark, sf_dir):
    given = F.expr("CASE p_partkey % 3 WHEN 0 THEN '　（' || p_name || '）' WHEN 1 THEN '( ' || p_name || ')' ELSE '(' || p_name || ') 外' END")
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_parens(given).alias("bare"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 9)::INT END AS chapter, CASE WHEN p_partkey % 2 = 0 THEN p_size::INT END AS section, CASE WHEN p_partkey % 2 = 0 THEN p_partkey || 'の2' END AS article FROM part")
def parse_clause_number(spark, sf_dir):
    n = text.parse_clause_number(F.expr("' ' || (p_partkey % 9) || '-' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '共' END || p_partkey || 'の2 '"))
    return table(spark, sf_dir, "part").select("p_partkey", *[n[c].alias(c) for c in ("chapter", "section", "article")])


@query("SELECT p_partkey, p_partkey::INT AS n, CASE WHEN p_partkey < 10 THEN '0' || p_partkey ELSE p_partkey::VARCHAR END AS two FROM part")
def digits_and_padding(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", text.digits_to_int(F.translate(key, "0123456789", "０１２３４５６７８９")).alias("n"), text.pad2(key).alias("two"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '税務署長 殿' || chr(10) || '国税庁長官' WHEN 1 THEN p_name || '（官印省略）' END AS issuer FROM part")
def issuer_lines(spark, sf_dir):
    lines = F.expr("CASE p_partkey % 3 WHEN 0 THEN array('本文', p_brand || '税務署長 殿', '国税庁長官') WHEN 1 THEN array(p_name || '（官印省略）', p_type) ELSE array(p_name) END")
    return table(spark, sf_dir, "part").select("p_partkey", text.issuer(lines).alias("issuer"))


@query("SELECT p_partkey, p_name || ' 1' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '【要点】' || chr(10) || p_type || chr(10) || p_brand ELSE '' END AS full_text FROM part")
def full_text_blocks(spark, sf_dir):
    lines = F.expr("CASE WHEN p_partkey % 2 = 0 THEN array(p_type, p_brand) ELSE cast(array() AS array<string>) END")
    return table(spark, sf_dir, "part").select("p_partkey", text.join_blocks(F.concat("p_name", F.lit("　１")), F.lit(None).cast("string"), text.headed("要点", lines)).alias("full_text"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ['comparison:extract_tables:b', 'attachment:extract_tables:a' || p_size, 'notice:read_text:d'] ELSE ['attachment:extract_tables:a' || p_size, 'qa-pdf:read_text:b', 'notice:read_text:d'] END AS hints FROM part""")
def pdf_hints(spark, sf_dir):
    files = F.expr("""array(named_struct('title', '別表', 'url', 'a' || p_size, 'size_kb', 1, 'kind', cast(null AS string)),
      named_struct('title', CASE WHEN p_partkey % 2 = 0 THEN '対比表' ELSE '質疑応答' END, 'url', 'b', 'size_kb', 2, 'kind', cast(null AS string)),
      named_struct('title', '様式', 'url', 'c', 'size_kb', 3, 'kind', cast(null AS string)), named_struct('title', p_name, 'url', 'd', 'size_kb', 4, 'kind', 'notice'))""")
    found = F.transform(pdf.hints(F.col("files")), lambda h: F.concat_ws(":", h["kind"], h["tool"], h["url"]))
    return table(spark, sf_dir, "part").withColumn("files", files).select("p_partkey", found.alias("hints"))
