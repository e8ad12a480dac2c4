"""Japanese era dates and dates in folder names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text

# The Gregorian year before the first year of each era.
ERAS = {"令和": 2018, "平成": 1988, "昭和": 1925, "大正": 1911, "明治": 1867}
ERA_DATE = rf"({'|'.join(ERAS)})\s*(\d+|元)\s*年\s*(\d+)\s*月\s*(\d+)\s*日"


def _padded(n: Column, width: int) -> Column:
    s = n.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", _padded(year, 4), _padded(month, 2), _padded(day, 2))


def era_date(s: Column, normalize: bool = True) -> Column:
    """The first era date of a text as YYYY-MM-DD (not checked against the calendar), else null."""
    t = normalize_text(s) if normalize else s
    at = lambda i: F.regexp_extract(t, ERA_DATE, i)
    base = F.element_at(F.create_map(*[F.lit(x) for kv in ERAS.items() for x in kv]), at(1))
    year = F.when(at(2) == "元", 1).otherwise(at(2).try_cast("int"))
    return F.when(t.rlike(ERA_DATE), iso(base + year, at(3).try_cast("int"), at(4).try_cast("int")))


def era_day(s: Column) -> Column:
    """``era_date`` as a date; null if there is no such day."""
    return era_date(s).try_cast("date")


def folder_date(url: Column) -> Column:
    """YYMMDD of a guideline's folder: years 1-31 count from 1988, 32-60 from 1925; else null."""
    rx = r"/jimu-unei/.+/(\d{2})(\d{2})(\d{2})(?:[_-]\d+)?/(?:index|01)\.htm$"
    yy, mm, dd = (F.regexp_extract(url, rx, i).try_cast("int") for i in (1, 2, 3))
    year = F.when(yy.between(1, 31), 1988 + yy).when(yy.between(32, 60), 1925 + yy)
    return F.when(mm.between(1, 12) & dd.between(1, 31) & year.isNotNull(), iso(year, mm, dd))
