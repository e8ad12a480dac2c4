"""What a whole run reads from a site: index pages of every kind, and the pages that show whether it still looks as expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Paths of the site, circulars with name, abbreviation and folder, topics of question-and-answer cases.
CIRCULARS = (
    ("消費税法基本通達", "消基通", "/law/tsutatsu/kihon/shohi/"),
    ("所得税基本通達", "所基通", "/law/tsutatsu/kihon/shotoku/"),
    ("法人税基本通達", "法基通", "/law/tsutatsu/kihon/hojin/"),
    ("相続税法基本通達", "相基通", "/law/tsutatsu/kihon/sisan/sozoku2/"),
)
QA_TOPICS = ("shotoku", "gensen", "joto", "sozoku", "hyoka", "hojin", "shohi", "inshi", "hotei")
INDEXES = {
    "kaisei": tuple(f"/law/tsutatsu/kihon/{x}/kaisei/kaisei_a.htm" for x in ("shohi", "shotoku", "hojin", "sisan/sozoku")),
    "jimu-unei": ("/law/jimu-unei/jimu.htm",),
    "bunshokaitou": ("/law/bunshokaito/01.htm",),
    "tax-answer": ("/taxes/shiraberu/taxanswer/code/",),
    "qa-jirei": tuple(f"/law/shitsugi/{t}/01.htm" for t in QA_TOPICS),
}
#: name, what the page must hold, path
CANARIES = (
    ("tsutatsu-shohi", "circular", "/law/tsutatsu/kihon/shohi/01/04.htm"),
    ("tsutatsu-shotoku", "circular", "/law/tsutatsu/kihon/shotoku/02/04.htm"),
    ("tsutatsu-hojin", "circular", "/law/tsutatsu/kihon/hojin/01/03.htm"),
    ("tsutatsu-sozoku", "circular", "/law/tsutatsu/kihon/sisan/sozoku/01.htm"),
    ("kaisei", "kaisei", "/law/tsutatsu/kihon/shohi/kaisei/kaisei_a.htm"),
    ("jimu-unei", "jimu-unei", "/law/jimu-unei/jimu.htm"),
    ("bunshokaitou", "bunshokaitou-main", "/law/bunshokaito/01.htm"),
    ("tax-answer", "document", "/taxes/shiraberu/taxanswer/shohi/6101.htm"),
    ("qa-jirei", "document", "/law/shitsugi/shohi/02/19.htm"),
)


def indexes(spark: SparkSession, site: str, doc_type: str) -> DataFrame:
    """url of the index pages of a document type; ``site`` is scheme and host."""
    return spark.createDataFrame([(site + p,) for p in INDEXES[doc_type]], "url string")


def circulars(spark: SparkSession, site: str) -> DataFrame:
    """formal_name, abbr, url of the tables of contents."""
    return spark.createDataFrame([(n, a, f"{site}{p}01.htm") for n, a, p in CIRCULARS], "formal_name string, abbr string, url string")


def canaries(spark: SparkSession, site: str) -> DataFrame:
    return spark.createDataFrame([(n, k, site + p) for n, k, p in CANARIES], "name string, kind string, url string")
