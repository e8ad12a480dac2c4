"""Pages made from rows of a small file are dealt over all cores; tags that the reader takes a short way for."""

import pytest

from lexispark.operators.pages import BlockReader
from lexispark.plans import parsers

D = "/root/testdata/sf0.001"


def blocks(html: str) -> list[tuple[str, str]]:
    reader = BlockReader("https://tax.example/a/b.htm")
    reader.feed(html)
    return [(b["tag"], b["text"]) for b in reader.blocks()]


@pytest.mark.parametrize("name", ["parse_documents", "parse_sections", "parse_qa_cases", "parse_tax_answers"])
def test_dealt(spark, name):
    # one task for each kind of page before
    assert getattr(parsers, name)(spark, D).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_reader_keeps_pages_attributes_apart():
    # an attribute of this name once counted as the reader's own mark, and hid the rest of the page
    assert blocks('<div id="bodyArea"><p _skip="1">甲</p><p>乙</p></div>') == [("p", "甲"), ("p", "乙")]
