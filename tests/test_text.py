import pytest
from pyspark.sql import functions as F

from lexispark.functions import dates, pdf, quality, text, urls

CASES = [
    (text.normalize_text, "７－３８～９　ゑ〜Ｋ", "7-38~9 ゑ~Ｋ"),
    (text.normalize_key, "\t９－２－２７　の ５ ", "9-2-27の5"),
    (text.normalize_query, "\n　繰延　　資産 　", "繰延 資産"),
    (text.clean_line, "\tp\n q　 r ", "p q r"),
    (text.clean_block, "p　\t q\n   r \n\n\n\n\ns\n", "p q\nr\n\ns"),
    (text.strip_parens, "（定義）", "定義"),
    (text.strip_parens, " (k) ", "k"),
    (text.strip_parens, "定義（７）", "定義（７）"),
    (lambda c: text.clause_number(c)["clause_number"], "９－２－27の5　役員", "9-2-27の5"),
    (lambda c: text.clause_number(c)["body"], "９－２－27の5　役員\n続く", "役員\n続く"),
    (lambda c: text.clause_number(c)["clause_number"], "204～207共－6 y", "204~207共-6"),
    (lambda c: text.clause_number(c)["clause_number"], "5の2・5の7共-3　y", "5の2・5の7共-3"),
    (lambda c: text.clause_number(c)["clause_number"], "番号のない文", None),
    (lambda c: text.parse_clause_number(c)["article"], " 9-2-27の5 ", "27の5"),
    (lambda c: text.parse_clause_number(c)["section"], "9-2-27", 2),
    (lambda c: text.parse_clause_number(c)["chapter"], "9-2", None),
    (text.digits_to_int, "４０５", 405),
    (text.digits_to_int, "四", None),
    (text.pad2, "4", "04"),
    (text.pad2, "", "00"),
    (text.pad2, "456", "456"),
    (dates.era_date, "【令和２年10月31日】", "2020-10-31"),
    (dates.era_date, "昭和元年12月31日", "1926-12-31"),
    (dates.era_date, "大正9年7月15日", "1920-07-15"),
    (dates.era_date, "１９９８年", None),
    (lambda c: dates.era_date(c, normalize=False), "平成９年２月３日", None),
    (dates.folder_date, "/law/jimu-unei/inshi/tebiki/300521/index.htm", "2018-05-21"),
    (dates.folder_date, "/law/jimu-unei/b/581103-2/01.htm", "1983-11-03"),
    (dates.folder_date, "/law/jimu-unei/b/001341/index.htm", None),
    (pdf.size_kb, "図（PDF/2,047KB）", 2047),
    (pdf.size_kb, "PDFファイル/0.5mb", 512),
    (pdf.size_kb, "図", None),
    (pdf.kind, "対比 表", "comparison"),
    (pdf.kind, "ＦＡＱ集", "qa-pdf"),
    (pdf.kind, "様式と連絡", "attachment"),
    (pdf.kind, "図面", "unknown"),
    (pdf.kind, None, "unknown"),
    (urls.reply_id, "https://x/about/organization/fukuoka/bunshokaito/inshi/070914/index.htm", "fukuoka/inshi/070914"),
    (urls.reply_id, "https://x/about/organization/sapporo/bunshokaito/hojin/9.htm", "sapporo/hojin/9"),
    (urls.guideline_id, "https://x/law/jimu-unei/hojin/k/581103-2/01.htm", "hojin/k/581103-2"),
    (urls.revision_taxonomy, "https://x/law/tsutatsu/kihon/hojin/kaisei/77/index.htm", "hojin"),
    (urls.answer_folder, "0123", None),
    (urls.answer_folder, "7123", "inshi"),
    (lambda c: urls.resolve_abbreviation(c)["formal_name"], "法基通", "法人税基本通達"),
    (lambda c: urls.resolve_abbreviation(c)["in_scope"], "民法", False),
    (urls.toc_style, "所得税基本通達", "shotoku"),
    (urls.toc_style, "別の通達", "shohi"),
    (urls.baseline_type, "別の通達", None),
    (lambda c: urls.section_url(F.lit("https://y/"), F.lit(23), c.cast("int")), "4", "https://y/23/04.htm"),
    (lambda c: urls.section_url(F.lit("https://y"), F.lit(3), c.cast("int")), "4", None),
    (lambda c: urls.section_url(F.lit("https://y/"), F.lit(3), c.cast("int")), "0", None),
    (lambda c: quality.days_since(c.cast("timestamp"), F.lit("2030-07-10T12:00:00Z")), "2030-06-01T12:00:01Z", 38),
    (lambda c: quality.days_since(c.cast("timestamp"), F.lit("2030-07-10T12:00:00Z")), None, 0),
    (lambda c: quality.staleness(c.cast("int")), "6", "fresh"),
    (lambda c: quality.staleness(c.cast("int")), "29", "stale"),
    (lambda c: quality.staleness(c.cast("int")), "31", "outdated"),
]


def test_scalars(spark):
    df = spark.createDataFrame([tuple(c[1] for c in CASES)], ", ".join(f"c{i} string" for i in range(len(CASES))))
    row = df.select(*[f(F.col(f"c{i}")).alias(f"c{i}") for i, (f, _, _) in enumerate(CASES)]).first()
    assert {i: v for i, v in enumerate(row) if v != CASES[i][2]} == {}


@pytest.mark.parametrize(("failed", "total", "least", "want"), [(5, 480, 5, True), (4, 380, 5, False), (5, 501, 5, False), (9, 0, 5, False)])
def test_fail_rate(spark, failed, total, least, want):
    assert spark.range(1).select(quality.warn_fail_rate(F.lit(failed), F.lit(total), F.lit(least))).first()[0] is want


def test_drift_and_structure(spark):
    d = [spark.range(1).select(quality.warn_drift(F.lit(t), F.lit(m))).first()[0] for t, m in ((80, 100.0), (81, 100.0), (120, 100.0), (7, 0.0))]
    s = [spark.range(1).select(quality.warn_structure(F.lit(u), F.lit(42))).first()[0] for u in (21, 22)]
    assert d == [True, False, True, False] and s == [False, True]


def test_pdf_hints_and_order(spark):
    df = spark.sql("SELECT from_json('[{\"title\":\"関連資料\",\"url\":\"m\"},{\"title\":\"付録イ\",\"url\":\"n\"},{\"title\":\"付録ロ\",\"url\":\"o\"},{\"title\":\"k\",\"url\":\"p\",\"kind\":\"comparison\"}]', 'array<struct<title:string,url:string,size_kb:int,kind:string>>') AS p")
    r = df.select(pdf.by_priority(pdf.fill_kinds(F.col("p"))).alias("s"), pdf.hints(F.col("p")).alias("h")).first()
    assert [x["url"] for x in r["s"]] == ["p", "n", "o", "m"]
    assert [(x["kind"], x["tool"], x["url"]) for x in r["h"]] == [("comparison", "extract_tables", "p"), ("attachment", "extract_tables", "n"), ("related", "read_text", "m")]


def test_issuer_and_blocks(spark):
    df = spark.sql("SELECT array('本文', '所管署長 殿', '（官印省略）') AS p, array('本文') AS q")
    r = df.select(
        text.issuer(F.col("p")).alias("a"), text.issuer(F.col("q")).alias("b"),
        text.join_blocks(F.lit("題１"), F.lit(None).cast("string"), F.lit(""), text.headed("要点", F.col("q"))).alias("c"), text.headed("要点", F.array().cast("array<string>")).alias("d"),
    ).first()
    assert tuple(r) == ("所管署長 殿\n（官印省略）", None, "題1\n\n【要点】\n本文", "")
