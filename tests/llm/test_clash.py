"""Columns of the input that are named like working columns stay as they are."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import lexispark.llm as llm
from lexispark.llm.decontaminate import drop_leaks
from lexispark.llm.langid import identify
from lexispark.llm.licenses import scan
from lexispark.llm.lines import drop_lines, line_dedup
from lexispark.llm.mixing import MixParams, mix
from lexispark.llm.pii import find_pii, redact
from lexispark.llm.quality import quality_filter, quality_rules
from lexispark.llm.simhash import keep_one, near_duplicates
from lexispark.llm.substring import substring_dedup
from lexispark.llm.tokens import token_counts

OWN = {"doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"}


def working_names() -> list[str]:
    code = "".join(p.read_text() for p in Path(llm.__path__[0]).glob("*.py"))
    return sorted({x for x in re.findall(r"[\"'(,\s](_?[a-z][a-z0-9_]*)\b[\"'=]", code) if len(x) < 14} - OWN)


@pytest.fixture
def rows(spark):
    words = " ".join(f"Word{chr(97 + i % 26)}{i}" for i in range(70)).replace("1", "e").replace("2", "a")
    data = [(i, f"{words} number {'x' * i}.\nshared line of some words\n{words[::-1]}", "en", f"s{i % 2}", 5) for i in range(14)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df):
    names = working_names()
    assert {"_k", "_sig", "_gone", "_new", "_row", "_id", "_own", "_source", "sig", "node"} <= set(names)
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names]), names


@pytest.mark.parametrize("stage", [quality_filter, drop_lines, keep_one, lambda d: drop_leaks(d, d.limit(1).select(F.lit(1).alias("item_id"), F.lit("no such words in here at all").alias("text"))), lambda d: mix(d, MixParams(max_broadcast_sources=0)), mix])
def test_whole_rows_stay(rows, stage):
    df, names = clashing(rows)
    plain, got = stage(rows), stage(df)
    assert got.columns[: len(df.columns)] == df.columns
    key = [c for c in plain.columns]
    assert sorted(map(str, got.select(key).collect())) == sorted(map(str, plain.collect()))
    for r in got.select("doc_id", *names).collect():
        assert all(r[n] == f"{n}:{r['doc_id']}" for n in names)


@pytest.mark.parametrize("operator", [quality_rules, line_dedup, near_duplicates, substring_dedup, find_pii, redact, token_counts, identify, scan])
def test_other_columns_are_ignored(rows, operator):
    df, _ = clashing(rows)
    assert sorted(map(str, operator(df).collect())) == sorted(map(str, operator(rows).collect()))
