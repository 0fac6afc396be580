"""Categories, product URLs, listings and recommendations."""

import json

import pytest
from pyspark.sql import functions as F

from catalogspark.functions.urls import normalize_url
from catalogspark.operators.alternatives import attach_alternatives, top_alternatives
from catalogspark.operators.discovery import (
    attach_source_category,
    canonical_categories,
    canonical_product_urls,
    category_from_slug,
    discover_categories,
    filter_by_intent,
)
from catalogspark.operators.ordering import cap_categories
from catalogspark.site import SiteConfig
from catalogspark.sources.listings import (
    explode_listing,
    extract_listing_config,
    filter_listing,
    page_listing,
    pages_past_cap,
    readable_pages,
)
from catalogspark.sources.pages import classify_pages
from catalogspark.sources.recs import explode_recs

SITE = SiteConfig()
B = SITE.base


def categories(spark, *pairs):
    return spark.createDataFrame([(n, u, i) for i, (n, u) in enumerate(pairs)], "name string, url string, position long")


def test_categories_are_canonical_and_distinct(spark):
    raw = categories(
        spark,
        ("Gloves", f"{B}/catalog/gloves"),
        ("Twice", f"{B}/catalog/gloves/"),
        ("", " /catalog/masks "),
        ("Sub", f"{B}/catalog/gloves/nitrile"),
        ("Root", f"{B}/catalog"),
        ("Off", "https://other.example.org/catalog/x"),
        ("Item", f"{B}/product/abc"),
        ("Route", f"{B}/catalog/category"),
        ("Upper", "HTTPS://WWW.shop.example.com/CATALOG/Tips"),
        ("None", None),
    )
    found = canonical_categories(raw, SITE).orderBy("position").collect()
    assert [(r.name, r.url, r.slug) for r in found] == [
        ("Gloves", f"{B}/catalog/gloves", "gloves"),
        ("masks", f"{B}/catalog/masks", "masks"),
        ("Upper", "HTTPS://WWW.shop.example.com/CATALOG/Tips", "Tips"),
    ]


def test_product_urls(spark):
    # each address with what becomes of it
    cases = [("/product/a1-b2/", f"{B}/product/a1-b2"), (f"{B.upper()}/product/q", None), (f"{B}/product/deep/er", None),
             (f"{B}/cart/product", None), (f"{B}/product/a1-b2", None), ("ftp://x.example.com/product/q", None), (None, None),
             (f"{B}/product/a1_b2", None), (f"{B}/product/q9", f"{B}/product/q9")]
    df = spark.createDataFrame([(u, i) for i, (u, _) in enumerate(cases)], "url string, position int")
    found = {r.position: r.url for r in canonical_product_urls(df, SITE).collect()}
    assert found[0] == cases[0][1] and found[8] == cases[8][1] and not {2, 3, 4, 5, 6, 7} & set(found)


def test_normalized_links(values):
    links = ["//h.example.com/p", "/product/x", "https://a.example.com/b", " http://c.example.com ", "", "not a url", "/other", None]
    assert values(lambda c: normalize_url(c, SITE), links) == [
        "https://h.example.com/p", f"{B}/product/x", "https://a.example.com/b", "http://c.example.com", "", "", "", "",
    ]


def test_category_from_slug(spark):
    df = spark.createDataFrame([("gloves",), ("/gloves/nitrile/",), ("https://x.example.com/c/deep/",)], "slug string")
    assert [tuple(r) for r in category_from_slug(df, SITE).collect()] == [
        ("gloves", f"{B}/catalog/gloves", "gloves"),
        ("nitrile", f"{B}/catalog/gloves/nitrile", "nitrile"),
        ("deep", "https://x.example.com/c/deep", "deep"),
    ]


def test_discovery_reads_modern_then_legacy_links(spark):
    html = (
        f'<a href="{B}/catalog/category/view/s/dams/id/9/">d</a><a href="{B}/catalog/gloves">g</a>'
        f'<a href="{B}/catalog/gloves/nitrile">n</a><a href="{B}/product/p">p</a><a href="https://o.example.org/catalog/x">x</a>'
        '<a href="/catalog/category/view/s/gloves/id/1">again</a><a href="/catalog/relative">r</a>'
    )
    pages = spark.createDataFrame([(0, html), (1, f'"{B}/catalog/late" {B}/catalog/dams'), (2, None)], "position int, html string")
    found = discover_categories(pages, SITE).orderBy("position").collect()
    assert [r.slug for r in found] == ["gloves", "dams", "late"]
    assert found[1].url == f"{B}/catalog/dams"


def test_intent(spark):
    df = categories(spark, ("Exam Gloves", "u1"), ("Surgical", "u2"), ("Tips", "u3")).withColumn("slug", F.lower("name"))
    assert filter_by_intent(df, None).count() == filter_by_intent(df, "  ").count() == 3
    assert {r.name for r in filter_by_intent(df, "I want gloves, and SURGICAL supplies").collect()} == {"Exam Gloves", "Surgical"}
    assert filter_by_intent(df, "chairs").count() == 0


def test_caps_and_source_category(spark):
    df = canonical_categories(categories(spark, ("A", "/catalog/a"), ("B", "/catalog/b"), ("C", "/catalog/c")), SITE)
    assert sorted(r.slug for r in cap_categories(df, 2).collect()) == ["a", "b"]
    assert cap_categories(df, None).count() == 3
    urls = spark.createDataFrame([("x", f"{B}/catalog/b")], "url string, category_url string")
    assert attach_source_category(urls, df).first().source_category == "b"
    unknown = spark.createDataFrame([("x", f"{B}/catalog/b"), ("y", "nowhere"), ("z", None)], "url string, category_url string")
    found = attach_source_category(unknown, df.unionByName(df)).collect()
    assert {(r.url, r.source_category) for r in found} == {("x", "b"), ("y", None), ("z", None)} and len(found) == 3


def test_page_types(spark):
    df = spark.createDataFrame([(f"{B}/catalog/a",), (f"{B}/product/a",), (f"{B}/cart",)], "url string")
    assert [r.page_type for r in classify_pages(df, SITE).collect()] == ["category", "product", "other"]


def test_listing_config(spark):
    whole = '"applicationId":"APP1","indexName" : "shop_en", "apiKey":"ab+/==" later {"category_id":"385","x":1} "category_id":"9"'
    df = spark.createDataFrame([("a", whole), ("b", whole.replace("category_id", "cat"))], "url string, html string")
    found = {r.url: r.config for r in extract_listing_config(df).collect()}
    assert tuple(found["a"]) == ("APP1", "ab+/==", "shop_en_products", "385")
    assert found["b"] is None


def test_listing_filter(spark):
    df = spark.createDataFrame([(["1", "2"], 1), (["1"], 0), (["3"], 1)], "categoryIds array<string>, visibility_catalog int")
    assert filter_listing(df, "1").count() == 1


def reply(pages, *urls):
    return json.dumps({"results": [{"hits": [{"url": u} for u in urls], "nbPages": pages}]})


def listed(spark, rows, site=SITE):
    df = spark.createDataFrame(rows, "category string, page_no int, payload string")
    hits = explode_listing(readable_pages(df, site)).orderBy("category", "page_no", "hit_pos")
    return [(r.category, r.url) for r in hits.collect()]


def test_paging_ends_with_the_last_page(spark):
    rows = [("c", 0, reply(2, "a", "b")), ("c", 1, reply(2, "a", "c")), ("c", 2, reply(2, "d"))]
    assert listed(spark, rows) == [("c", "a"), ("c", "b"), ("c", "a"), ("c", "c")]


CUT, LONG = reply(5, "z")[:-2], reply(5, "z") + ", {}"


@pytest.mark.parametrize("bad", [None, "busy", '{"results": []}', "{}", "[]", "", CUT, LONG])
def test_paging_ends_before_a_lost_page(spark, bad):
    rows = [("c", 0, reply(5, "a")), ("c", 1, bad), ("c", 2, reply(5, "b")), ("d", 1, reply(2, "x"))]
    assert listed(spark, rows) == [("c", "a")]


def test_paging_cap_and_missing_page_count(spark):
    many = [("c", i, reply(99, f"u{i}")) for i in range(6)]
    small = SiteConfig(listing_max_pages=4)
    assert len(listed(spark, many, small)) == 4 and len(listed(spark, many)) == 6
    replies = spark.createDataFrame(many, "category string, page_no int, payload string")
    assert [tuple(r) for r in pages_past_cap(replies, small).collect()] == [("c", 2)] and not pages_past_cap(replies).count()
    assert listed(spark, [("c", 0, '{"results":[{"hits":[{"url":"a"},{"url":""},{}]}]}'), ("c", 1, reply(2, "b"))]) == [("c", "a")]


def test_page_listing_marks_the_cap(spark):
    df = spark.range(25).select(F.when(F.col("id") < 21, "big").otherwise("small").alias("category"), F.col("id").alias("rank"))
    paged = page_listing(df, SiteConfig(hits_per_page=5, listing_max_pages=3)).collect()
    assert sorted(r["rank"] for r in paged if r.category == "big") == list(range(15))
    assert {(r.category, r.hit_page_cap) for r in paged} == {("big", True), ("small", False)}
    assert all(r.page == (r.hit_no - 1) // 5 for r in paged)


def payload(*units):
    return json.dumps({"results": list(units)})


def unit(*products):
    return {"products": [{"sku": s, "url": u} for s, u in products]}


@pytest.fixture
def top(spark):
    def run(text, k=10, sku="ME"):
        df = spark.createDataFrame([(sku, text)], "sku string, payload string")
        row = top_alternatives(explode_recs(df), k, SITE).first()
        return row and row.alternatives

    return run


def test_recs_are_distinct_without_the_product_itself(top):
    text = payload(unit(("A", "//h.example.com/a"), ("ME", "//h.example.com/me"), ("B", "/product/b")),
                   unit(("B2", "/product/b"), ("C", "https://h.example.com/c")))
    assert top(text) == ["https://h.example.com/a", f"{B}/product/b", "https://h.example.com/c"]
    assert top(text, 2) == ["https://h.example.com/a", f"{B}/product/b"]
    assert top(text, 0) == ["https://h.example.com/a"]
    assert top(text, sku="") is None


def test_malformed_recs_are_skipped(top):
    text = payload(None, {"products": "none"}, "x", unit(("OK", "/product/ok")), {"products": [None, 3, {"sku": "no-url"}, {"url": "/product/no-sku"},
                   {"sku": "", "url": "/product/blank"}, {"sku": "bad", "url": 5}]})
    assert top(text) == [f"{B}/product/ok"]
    assert [top(t) for t in ('{"results": []}', "{}", "[]", "oops", None, '{"results": {"products": []}}')] == [None] * 6


def test_alternatives_replace_only_when_given(spark):
    products = spark.createDataFrame([("A", ["old"]), ("B", ["kept"])], "sku string, alternative_products array<string>")
    found = spark.createDataFrame([("A", ["new"]), ("B", [])], "sku string, alternatives array<string>")
    rows = {r.sku: r.alternative_products for r in attach_alternatives(products, found).collect()}
    assert rows == {"A": ["new"], "B": ["kept"]}
