"""Main text: the messages against enumeration, pages against plain patterns and known layouts, and odd markup."""

from __future__ import annotations

import html as entities
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from catalogspark.llm import main_text, page_layouts
from catalogspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def whole(html):
    """All text of a page, as if all of it were main text."""
    tree = main_text.parse(html)
    return main_text.lines(tree, range(len(tree.runs)))


def by_patterns(html):
    """The article of a page of the test tables."""
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body)
    return "\n".join(x for b in blocks if (x := " ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split())))


def test_messages_give_the_marginals_of_enumeration():
    rng = np.random.default_rng(4)
    parent = np.array([-1, 0, 0, 1, 1, 2, 5, -1, 7])
    depth = np.array([0, 1, 1, 2, 2, 2, 3, 0, 1])
    n = len(parent)
    model = main_text.Model({f"f{i}": i for i in range(n)}, {"a": 0, "b": 1})
    model.weights, model.tables = rng.normal(size=n) * 2, rng.normal(size=(3, 2, 2)) * 2
    kind = rng.integers(0, 3, n)
    forest = main_text.Forest(parent, depth, kind, np.arange(n), np.arange(n), np.arange(n), np.zeros(n, int))
    total, single, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for states in itertools.product((0, 1), repeat=n):
        score = sum(model.weights[i] * states[i] for i in range(n))
        score += sum(model.tables[kind[i], states[parent[i]], states[i]] for i in range(n) if parent[i] >= 0)
        weight = np.exp(score)
        total += weight
        single += weight * np.array(states)
        for i in range(n):
            if parent[i] >= 0:
                pairs[i, states[parent[i]], states[i]] += weight
    marginal, joint = model.pass_messages(forest)
    assert np.allclose(marginal, single / total)
    assert np.allclose(joint[parent >= 0], pairs[parent >= 0] / total)


def test_query_against_patterns(spark):
    got = QUERIES["op11_html_extraction"](spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in got.collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages) == got.count()
    for page in pages:
        r = found[page.page_id]
        assert (r.url, r.n_chars) == (page.url, len(r.text))
        assert r.text == by_patterns(page.html)


@pytest.fixture(scope="module")
def model(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return main_text.fit(page_layouts.labelled_pages(pages, main_text.Training(pages=200)))


def test_held_out_pages_and_layouts(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert main_text.main_texts(model, [p.html for p in pages]) == [by_patterns(p.html) for p in pages]
    layouts = [x for p in pages for x in list(page_layouts.labelled_from(p.html, p.page_id + 10**6, 6))[1:]]
    found = main_text.main_texts(model, [h for h, _ in layouts])
    shared = wanted = given = 0
    for got, (_, want) in zip(found, layouts):
        a, b = Counter(got.split("\n")), Counter(want.split("\n"))
        shared, given, wanted = shared + sum((a & b).values()), given + sum(a.values()), wanted + sum(b.values())
    assert len(layouts) > 100 and shared / given > 0.85 and shared / wanted > 0.85


SITE = """<!doctype html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies to make this page better for you.</div>
<header id="masthead"><a href="/">Home</a><p>The daily page</p></header><ul class="menu"><li><a href="/a">One</a><li><a href="/b">Two</a></ul>
<div class="content"><h1>Title &amp; more</h1><p>First   paragraph with <a href="/x">a link</a> and
some words that make it long enough to count.<p>Second &lt;b&gt; paragraph, which goes on for a while as well.
<div class="ad">Buy now and save a lot of money on things.</div><p>Third paragraph of the article, the last one here.</div>
<div id="comments"><h3>Comments</h3><div class="comment"><b>Ann</b> <p>I liked this text very much, thank you.</p></div></div>
<form class="newsletter"><p>Sign up for our letter</p><input><button>Go</button></form>
<div class="sidebar"><h4>Related</h4><a href="/q">Other text</a></div><footer>&copy; 2024 The page. All rights reserved.</footer></body></html>"""


def test_parts_of_another_site(model):
    want = ["Title & more", "First paragraph with a link and some words that make it long enough to count.", "Second <b> paragraph, which goes on for a while as well.", "Third paragraph of the article, the last one here."]
    assert main_text.main_texts(model, [SITE]) == ["\n".join(want)]


def test_malformed_markup():
    assert whole("") == [] and whole(" <p> </p> ") == []
    assert whole("a<b>b<p>c</b>d<br>e</p>f") == ["ab", "cd e", "f"]
    assert whole("x < 3 and 4 > 2 &#233;&#x20AC;&bogus; &nbsp;&amp;") == ["x < 3 and 4 > 2 é€&bogus; &"]
    assert whole("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert whole("<table><tr><td>a<td>b<tr><th>c<table><tr><td>d</table>e</table>f") == ["a", "b", "c", "d", "e", "f"]
    assert whole("<SCRIPT>if (a < b) '</p>'</SCRIPT>x<!-- <p>no --><style>p{}</style >y<script>never ends") == ["xy"]
    assert whole("<p title='a > b' class=\"x'y\">in</p></div></p></span>out<select><option>no</select>") == ["in", "out"]
    assert whole("a<!-- never ends <p>b") == ["a"]
    deep = whole("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after")
    assert deep == ["deep", "after"]
    rng = random.Random(0)
    for _ in range(300):
        main_text.parse("".join(rng.choices(["<", ">", "p", "/", "a ", '"', "'", "<!--", "-->", "=", "<p>", "</p>", "<a href='", "<![CDATA[", "&#", "<script>", "x"], k=60)))


def test_odd_rows(spark, model):
    html = spark.read.parquet(f"{SF}/pages.parquet").first().html
    long = html.replace("</article>", "<p>word and more words, again.</p>" * 20_000 + "</article>")
    rows = [(1, "u", None), (2, None, ""), (None, "u", html), (3, "v", html), (3, "v", html), (4, "w", "plain"), (5, "x", long), (6, "y", "<p> </p>")]
    pages = spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    small = main_text.Training(pages=20, steps=40)
    labelled = page_layouts.labelled_pages(pages, small)
    assert labelled == page_layouts.labelled_pages(pages.repartition(3), small)
    got = main_text.extract(pages, labelled, small)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert len(found) == len(rows) and all(r[3] == len(r[2]) for r in found)
    by_id = {r[0]: r[2] for r in found}
    assert by_id[1] == by_id[2] == by_id[6] == "" and by_id[3] == by_id[None] == by_patterns(html)
    assert by_id[5].count("\n") > 20_000
    assert sum(r[0] == 3 for r in found) == 2
    empty = pages.limit(0)
    assert main_text.extract(empty, page_layouts.labelled_pages(empty, small), small).count() == 0
    assert main_text.extract(pages.where("html IS NULL"), [], small).collect()[0].text == ""
