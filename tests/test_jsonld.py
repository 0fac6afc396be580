import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from catalogspark.functions.jsonld import breadcrumb_path, jsonld_blocks, jsonld_entities, with_product_jsonld

PRODUCT = {
    "@type": "Product",
    "sku": " K-1 ",
    "name": "Mask",
    "description": "soft",
    "brand": {"@type": "Brand", "name": "Acme"},
    "image": ["https://i.example.com/1.jpg", "", None],
    "url": "https://shop.example.com/product/mask",
    "offers": {"price": "12.50", "priceCurrency": "USD", "availability": "https://schema.org/InStock"},
}


def page(*blocks):
    scripts = (b if isinstance(b, str) else json.dumps(b) for b in blocks)
    return "<html>" + "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts) + "</html>"


@pytest.fixture
def product_of(spark):
    def read(html):
        df = spark.createDataFrame([(html,)], "html string").select(jsonld_entities(F.col("html")).alias("e"))
        return with_product_jsonld(df, "e", "p").first().p

    return read


def changed(**fields):
    return PRODUCT | fields


def test_core_fields(product_of):
    p = product_of(page(PRODUCT))
    assert (p.sku, p.name, p.description, p.brand) == ("K-1", "Mask", "soft", "Acme")
    assert (p.price, p.price_text, p.currency, p.availability) == (Decimal("12.5"), "12.50", "USD", "InStock")
    assert p.image_urls == ["https://i.example.com/1.jpg"]
    assert p.product_url == "https://shop.example.com/product/mask"


def test_page_without_product(product_of):
    assert product_of("<html><body>nothing</body></html>") is None
    assert product_of(page({"@type": ["Product"], "sku": "K"})) is None
    assert product_of(page('{"@type": "Product", "sku": "K"},,')) is None
    assert product_of(None) is None


def test_shapes_of_the_block(product_of):
    for block in (
        [{"@type": "WebSite"}, "text", PRODUCT],
        {"@graph": [{"@type": "WebSite"}, PRODUCT]},
        '\n  ' + json.dumps(PRODUCT) + '\n',
    ):
        assert product_of(page("{broken", block)).sku == "K-1"
    nested = [{"@graph": [PRODUCT]}]
    assert product_of(page(nested)) is None  # a list item's own graph stays closed


def test_first_product_wins(product_of):
    assert product_of(page(changed(sku="first"), PRODUCT)).sku == "first"


def test_polymorphic_fields(product_of):
    assert product_of(page(changed(offers=[{"price": 7}, {"price": 8}]))).price == 7
    assert product_of(page(changed(offers=[]))).price is None
    assert product_of(page(changed(offers="none"))).price is None
    assert product_of(page(changed(brand="Plain"))).brand == "Plain"
    assert product_of(page(changed(brand=["x"]))).brand is None
    assert product_of(page(changed(image="https://i.example.com/s.jpg"))).image_urls == ["https://i.example.com/s.jpg"]
    assert product_of(page(changed(image={"url": "https://i.example.com/o.jpg"}))).image_urls == ["https://i.example.com/o.jpg"]
    assert product_of(page({"@type": "Product"})).image_urls == []


def test_odd_values(product_of):
    assert product_of(page(changed(sku=4711))).sku == "4711"
    assert product_of(page(changed(sku="  "))).sku is None
    assert product_of(page(changed(name=None))).name is None
    assert product_of(page(changed(offers={"price": "1,234.00"}))).price is None
    assert product_of(page(changed(offers={"price": ""}))).price is None
    assert product_of(page('{"@type":"Product","sku":"a","sku":"b"}')).sku == "b"


def test_script_tag_variants(values):
    html = (
        "<SCRIPT data-a='1' TYPE='application/ld+json' id=x>\n[1,\n2]</SCRIPT><script type=\"application/ld+json\">{}</script>"
        '<script type="text/json">{"no":1}</script><script type="application/ld+json">{"raw": "a\nb"}</script>'
    )
    assert values(lambda h: F.size(jsonld_blocks(h)), [html]) == [2]


def crumbs(*items):
    return page({"@type": "BreadcrumbList", "itemListElement": list(items)})


def test_breadcrumbs(values):
    def path(h):
        return breadcrumb_path(jsonld_entities(h))

    full = crumbs(
        {"position": 3, "name": " Gloves "}, {"position": 1, "name": "Home"}, {"position": 2, "name": "Supplies"},
        {"position": 4, "name": "Item"}, {"position": 2.5, "name": "  "}, {"position": 2.7, "name": 9}, "stray",
    )
    unordered = crumbs({"name": "Home"}, {"name": "A"}, {"name": "B"}, {"name": "Item"})
    short = crumbs({"position": 1, "name": "Home"}, {"position": 2, "name": "Item"})
    assert values(path, [full, unordered, short, page(PRODUCT), "x"]) == [["Supplies", "Gloves"], ["A", "B"], [], [], []]
