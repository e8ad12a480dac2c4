"""Keys and categories read from URLs, and URLs built from keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import found

# The URL families, tried in order, and the lookups by name or first digit.
REVISION_ID = r"/kaisei/([^/]+)/index\.htm"
REVISION_TAXONOMY = r"/law/tsutatsu/kihon/([^/]+(?:/[^/]+)?)/kaisei/"
GUIDELINE_ID = r"/law/jimu-unei/(.+?)/(?:index|01)\.htm$"
GUIDELINE_TAXONOMY = r"/law/jimu-unei/([^/]+)/"
REPLY_ID = (r"/law/bunshokaito/(.+?)/index\.htm$", r"/about/organization/([^/]+)/bunshokaito/(.+?)/index\.htm$", r"/about/organization/([^/]+)/bunshokaito/(.+?)\.htm$")
REPLY_TAXONOMY = (r"/law/bunshokaito/([^/]+)/", r"/about/organization/[^/]+/bunshokaito/([^/]+)/")
BUREAUS = {
    "tokyo": "東京国税局", "osaka": "大阪国税局", "nagoya": "名古屋国税局", "sendai": "仙台国税局", "sapporo": "札幌国税局", "kantoshinetsu": "関東信越国税局",
    "kanazawa": "金沢国税局", "hiroshima": "広島国税局", "takamatsu": "高松国税局", "fukuoka": "福岡国税局", "kumamoto": "熊本国税局", "okinawa": "沖縄国税事務所",
}
HEAD_OFFICE = "国税庁"
ANSWER_FOLDERS = {"1": "shotoku", "2": "gensen", "3": "joto", "4": "sozoku", "5": "hojin", "6": "shohi", "7": "inshi", "9": "osirase"}
TOC_STYLES = {"消費税法基本通達": "shohi", "所得税基本通達": "shotoku", "法人税基本通達": "hojin", "相続税法基本通達": "sozoku"}
ABBREVIATIONS = {
    "消基通": "消費税法基本通達", "所基通": "所得税基本通達", "法基通": "法人税基本通達", "相基通": "相続税法基本通達",
    "通基通": "国税通則法基本通達", "徴基通": "国税徴収法基本通達", "措通": "租税特別措置法関係通達", "印基通": "印紙税法基本通達",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """Null for keys outside the table."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def first_group(url: Column, *patterns: str) -> Column:
    return F.coalesce(*[found(F.regexp_extract(url, rx, 1)) for rx in patterns])


def revision_id(url: Column) -> Column:
    return first_group(url, REVISION_ID)


def revision_taxonomy(url: Column) -> Column:
    return first_group(url, REVISION_TAXONOMY)


def guideline_id(url: Column) -> Column:
    return first_group(url, GUIDELINE_ID)


def guideline_taxonomy(url: Column) -> Column:
    return first_group(url, GUIDELINE_TAXONOMY)


def reply_id(url: Column) -> Column:
    """Head-office replies by their path, a bureau's with the bureau in front."""
    bureau = [F.when(url.rlike(rx), F.concat_ws("/", F.regexp_extract(url, rx, 1), F.regexp_extract(url, rx, 2))) for rx in REPLY_ID[1:]]
    return F.coalesce(found(F.regexp_extract(url, REPLY_ID[0], 1)), *bureau)


def reply_taxonomy(url: Column) -> Column:
    return first_group(url, *REPLY_TAXONOMY)


def reply_issuer(first_named: Column, url: Column) -> Column:
    """The paragraph that names a sender, else the bureau of the URL, else the head office."""
    bureau = found(F.regexp_extract(url, r"/about/organization/([^/]+)/bunshokaito/", 1))
    return F.coalesce(first_named, lookup(BUREAUS, bureau), bureau, F.when(url.contains("/law/bunshokaito/"), F.lit(HEAD_OFFICE)))


def section_url(root: Column, chapter: Column, section: Column) -> Column:
    """Root, chapter and section of two digits or more; null if the root lacks its slash or a number is below 1."""
    two = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    return F.when(root.endswith("/") & (chapter >= 1) & (section >= 1), F.concat(root, two(chapter), F.lit("/"), two(section), F.lit(".htm")))


def answer_folder(number: Column) -> Column:
    """Folder of a tax answer by the first digit of its number; null for digits without one."""
    return lookup(ANSWER_FOLDERS, F.substring(number, 1, 1))


def toc_style(name: Column) -> Column:
    return F.coalesce(lookup(TOC_STYLES, name), F.lit("shohi"))


def baseline_type(name: Column) -> Column:
    """Name of a circular's run history; null for circulars without a style."""
    return F.concat(F.lit("tsutatsu-"), lookup(TOC_STYLES, name))


def resolve_abbreviation(abbr: Column) -> Column:
    """Struct formal_name, in_scope: full names stand for themselves; in scope are the circulars that can be ingested."""
    name = F.coalesce(lookup(ABBREVIATIONS, abbr), F.when(abbr.isin(*ABBREVIATIONS.values()), abbr))
    return F.struct(name.alias("formal_name"), F.coalesce(name.isin(*TOC_STYLES), F.lit(False)).alias("in_scope"))


def abbreviation(name: Column) -> Column:
    """Abbreviation of a full name; a name without one stands for itself."""
    return F.coalesce(lookup({v: k for k, v in ABBREVIATIONS.items()}, name), name)
