"""Inline variant data and markup."""

import pytest
from pyspark.sql import functions as F

from catalogspark.functions.inline import master_data_text, with_master_data
from catalogspark.functions.markup import _FieldReader, _fields_of, dom_enrichments, markup_candidate, read_fields


@pytest.fixture
def master_of(spark):
    def read(literal):
        df = spark.createDataFrame([(f'<script>window.masterData = "{literal}";</script>',)], "html string")
        return tuple(with_master_data(df.select(master_data_text(F.col("html")).alias("raw")), "raw", "d").first().d)

    return read


def quoted(text):
    return text.replace('"', "\\u0022")


def test_variants_follow_their_position_then_the_source(master_of):
    text = (
        '{"z":{"sku":"3","manufacturer_part_number":"M3","manufacturer_name":"Beta","position":3},'
        '"y":{"sku":" 1 ","manufacturer_part_number":"M1","manufacturer_name":"Alpha","position":1},'
        '"x":{"sku":"0","manufacturer_part_number":" ","manufacturer_name":"Beta"},'
        '"w":{"sku":"00","position":"7"},"v":"no object","u":[1],"t":{"sku":5,"position":9}}'
    )
    assert master_of(quoted(text)) == (["0", "00", "1", "3"], ["M1", "M3"], "Beta")


def test_equally_frequent_brands_give_the_first(master_of):
    text = '{"b":{"manufacturer_name":"Zeta"},"a":{"manufacturer_name":"Alpha"}}'
    assert master_of(quoted(text)) == (None, None, "Zeta")


def test_a_repeated_key_has_its_last_value_in_its_first_place(master_of):
    text = '{"a":{"sku":"1"},"b":{"sku":"2"},"a":{"sku":"3"},"c":{"sku":"4"},"b":{"sku":"5"}}'
    assert master_of(quoted(text)) == (["3", "5", "4"], None, None)


def test_escapes_of_the_literal(master_of):
    assert master_of(r"{\"a\":{\"sku\":\"x\/1\",\"manufacturer_name\":\"D\'Or é \xe9 é\"}}") == (["x/1"], None, "D'Or é é é")
    assert master_of(r"{\x22a\x22:{\x22sku\x22:\x22q\x22}}") == (["q"], None, None)


@pytest.mark.parametrize("literal", ["", "[1]", "broken", quoted('{"a":{}}'), quoted('{"a":{"sku":"1"}} tail')])
def test_unusable_data_gives_nothing(master_of, literal):
    assert master_of(literal) == (None, None, None)


def test_long_literal_is_read_whole(master_of):
    entries = ",".join(f'"k{i}":{{"sku":"{i}","position":{i}}}' for i in range(3000))
    assert master_of(quoted("{" + entries + "}"))[0] == [str(i) for i in range(3000)]


def test_pack_size_by_class_then_attribute():
    assert read_fields('<p class="a product-pack-size"> 10 <b> / box</b></p><i data-pack-size="9">x</i>')["pack_size"] == "10/ box"
    assert read_fields('<p class="product-pack-size"> </p><i data-pack-size="9"> 8/bag <br></i>')["pack_size"] == "8/bag"
    assert read_fields('<i data-pack-size="9"></i><i data-pack-size="1">2</i>')["pack_size"] is None


def test_specifications_keep_the_last_value():
    html = (
        '<table class="data"><tr><th>Size</th><td> 1 <i>cm</i></td></tr><tr><th>Only head</th></tr>'
        "<tr><th>Size<td>2 cm<tr><td>x</td><th>Late</th></table><table><tr><th>No</th><td>data</td></tr></table>"
        '<div class="additional-attributes-table"><table><tr><th>&Auml;</th><td>&lt;b&gt;</td></tr></table></div>'
    )
    assert dict(read_fields(html)["specifications"]) == {"Size": "2 cm", "Late": "x", "Ä": "<b>"}


def test_related_links_once_each_in_order():
    html = (
        '<div class="related-products"><a href="/product/b">b</a><a href="/product/a">a</a><a href="/x">x</a><a>n</a>'
        '<a href="/product/b">b</a></div><a href="/product/outside">o</a><ul class="product-items">'
        '<a class="other" href="/product/c">c</a><a class="product-item-link" href="/product/d">d</a></ul>'
        '<section class="upsell-products big"><p><a href="https://e.example.com/product/e">e</a></section>'
    )
    assert read_fields(html)["alternative_products"] == ["/product/b", "/product/a", "/product/d", "https://e.example.com/product/e"]


def test_only_pages_with_a_hint_reach_python(spark):
    pages = ["<table class='wide data'><tr><th>a</th><td>b</td></tr></table>", "<table><tr></table> data", None, "<p>plain"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").coalesce(1)
    rows = df.select("i", markup_candidate(F.col("html")).alias("c")).select("i", "c", dom_enrichments(F.col("c")).alias("d"))
    found = {r.i: (r.c is not None, r.d and r.d.specifications) for r in rows.collect()}
    assert found == {0: (True, {"a": "b"}), 1: (False, None), 2: (False, None), 3: (False, None)}


PLAIN = (
    '<!DOCTYPE html><div class="product-pack-size"> <b>5</b>/tray</div>',
    "<TABLE class='data table'><tr><th>a &amp; b<td>1<tr><th>c</th><td>2<br/>3</td></table>",
    '<ul class="product-items"><li><a class="product-item-link x" href="/product/1">x</a><li><a href="/product/2">y</a></ul>',
    '<script>if (a < b) { x = "</b>"; }</script><style>a>b{}</style><!-- c --><p data-pack-size>2/box</p>',
    '<title>t</title><div class="upsell-products"><a href="/product/1" href=\'/product/2\' />z</div><a href="/product/3">',
)
OTHER = (
    '<p data-pack-size=x>1/box</p>',
    '<div class="related-products"><a href="/product/1?a=1&amp;b=2">x</a></div>',
    '<div class="product-pack-size">1 < 2</div>',
    '<script>a<!-- b --></script><p data-pack-size>1</p>',
    '<p class="a"class="product-pack-size">1</p>',
    '<textarea><p data-pack-size>1</p></textarea>',
    '<td data-pack-size>1<script>unclosed',
)


@pytest.mark.parametrize("page", PLAIN + OTHER)
def test_plain_markup_is_read_as_the_parser_reads_it(page):
    parser = _FieldReader()
    assert parser.feed_plain(page) == (page in PLAIN)
    parser = _FieldReader()
    parser.feed(page)
    parser.close()
    assert read_fields(page) == _fields_of(parser)
