"""Inputs that once were not bounded: pages of unclosed tags, a labelled row that comes very often, very many test items."""

import time

import pytest

from meander.llm import decontaminate, quality_classifier, url_filter


@pytest.mark.parametrize("unit", ["<a ", "<a href ", "<a href=", '<a href="', "<a href= ", "<a href" + " " * 40])
def test_pages_of_unclosed_tags_take_linear_time(spark, unit):
    html = unit * (10_000_000 // len(unit)) + '<A HREF = "https://Other.org/x">'
    began = time.perf_counter()
    pages = spark.createDataFrame([("http://one.net/", html)], "url string, html string")
    found = {tuple(r) for r in url_filter.host_edges(pages).collect()}
    assert found == {("one.net", "other.org")} and time.perf_counter() - began < 60


def test_links(spark):
    html = "<a href='//b.org'>x</a> <a class=z href=http://c.org/?q>y <a\nhref = \"HTTPS://D.org#f\"> <a title='>' href='//no.org'> <a href='/own'> <ab href='//no.org'>"
    rows = url_filter.host_edges(spark.createDataFrame([("http://a.org/", html)], "url string, html string")).collect()
    assert {r["dst"] for r in rows} == {"b.org", "c.org", "d.org"}


def test_a_labelled_row_that_is_repeated_is_one_training_row(spark):
    docs = spark.range(200_000).selectExpr("id % 3 AS doc_id", "concat('some words ', id % 3) AS text")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert quality_classifier.training_rows(docs, labels, "text", "doc_id", "quality", 3000).count() == 3


def test_items_in_many_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCKS_AT_ONCE", 2)
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "clean words " + " ".join(f"w{i % 11}x{k}" for k in range(12)) + " more") for i in range(30)], "doc_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.report(docs, items, block_bytes=b).collect())) for b in (10**6, 60))
    assert one == many and sum(r[5] for r in one) == sum(i % 11 < 9 for i in range(30))
    cut = [decontaminate.scan(docs, items, block_bytes=b, most_covered=0.9).select("doc_id", "text") for b in (10**6, 60)]
    assert sorted(map(tuple, cut[0].collect())) == sorted(map(tuple, cut[1].collect()))
