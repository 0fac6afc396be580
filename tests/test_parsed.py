"""Extraction from stored blocks: the same records as from the HTML, and none of it is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.plans.extraction import extract_partial, partial_of_blocks
from catalogspark.sources.parsed import read_blocks, store_blocks
from workloads.queries import static_pages

SF = "/root/testdata/sf0.001"


def texts(df):
    partial = F.to_json("partial", {"ignoreNullFields": "false"})
    return sorted((r.url, r.text, r.method, r.missing) for r in df.select("url", partial.alias("text"), "method", "missing").collect())


def test_blocks_give_the_records_of_the_pages(spark, tmp_path):
    pages = static_pages(spark, SF)
    store_blocks(pages, f"{tmp_path}/blocks")
    stored = read_blocks(spark, f"{tmp_path}/blocks")
    assert "html" not in stored.columns
    got = texts(partial_of_blocks(stored))
    assert got == texts(extract_partial(pages)) and len(got) == pages.count()


def test_reading_them_parses_no_html(spark, tmp_path):
    store_blocks(static_pages(spark, SF), f"{tmp_path}/blocks")
    again = partial_of_blocks(read_blocks(spark, f"{tmp_path}/blocks")).select("url", "partial.name", "partial.pack_size")
    text = again._jdf.queryExecution().executedPlan().toString()
    assert "html" not in text and "application/ld" not in text and "masterData" not in text and "_markup" not in text


def test_pages_without_html_and_empty_tables(spark, tmp_path):
    pages = spark.createDataFrame([("u", None, "kept"), ("v", "", "kept"), ("w", "<p>no data</p>", "kept")], "url string, html string, more string")
    store_blocks(pages, f"{tmp_path}/blocks")
    read = partial_of_blocks(read_blocks(spark, f"{tmp_path}/blocks"))
    assert {(r.url, r.more, r.method, r.partial.name) for r in read.collect()} == {(u, "kept", "dom", None) for u in "uvw"}
    store_blocks(pages.limit(0), f"{tmp_path}/blocks")
    assert partial_of_blocks(read_blocks(spark, f"{tmp_path}/blocks")).count() == 0
