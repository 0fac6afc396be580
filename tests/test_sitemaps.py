"""Sitemaps, ranked intent, aligned variants and prompts that overlap."""

import gzip
import math
import re
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from catalogspark.functions.inline import master_data_text
from catalogspark.operators.intent import grams, intent_scores, rank_by_intent
from catalogspark.plans.extraction import extract_variants
from catalogspark.site import SiteConfig
from catalogspark.sources.pages import build_fallback_requests
from catalogspark.sources.sitemaps import last_change, listed_changes, parse_sitemaps, read_sitemaps

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


def entry(loc, lastmod=None):
    return f"<url><loc>{loc}</loc>{f'<lastmod>{lastmod}</lastmod>' if lastmod else ''}</url>"


def test_times(values):
    texts = ["2024", "2024-05", "2024-05-06", "2024-05-06T07:08Z", "2024-05-06T07:08:09+02:00", "2024-05-06T07:08:09.5Z", " 2024-05-06T07:08 ", "soon", "2024-13-01", "", None]
    assert values(last_change, texts) == [
        datetime(2024, 1, 1), datetime(2024, 5, 1), datetime(2024, 5, 6), datetime(2024, 5, 6, 7, 8), datetime(2024, 5, 6, 5, 8, 9),
        datetime(2024, 5, 6, 7, 8, 9, 500000), datetime(2024, 5, 6, 7, 8), None, None, None, None,
    ]


def test_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(HEAD + entry(" u1 ", "2024-01-02") + entry("u2?a=1&amp;b=2") + entry(" ") + "</urlset>")
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress((HEAD + entry("u1", "2024-03-01T00:00Z") + entry("u3", "x") + "</urlset>").encode()))
    read = read_sitemaps(spark, str(tmp_path))
    assert sorted((r.url, r.lastmod) for r in read.where("lastmod IS NOT NULL").collect()) == [("u1", datetime(2024, 1, 2)), ("u1", datetime(2024, 3, 1))]
    assert {(r.url, r.lastmod) for r in listed_changes(read).collect()} == {("u1", datetime(2024, 3, 1)), ("u2?a=1&b=2", None), ("u3", None)}
    index = tmp_path / "index"
    index.mkdir()
    (index / "i.xml").write_text("<sitemapindex><sitemap><loc>s1</loc></sitemap><sitemap><loc>s2</loc><lastmod>2024</lastmod></sitemap></sitemapindex>")
    assert [(r.url, r.lastmod) for r in read_sitemaps(spark, str(index), "sitemap").orderBy("url").collect()] == [("s1", None), ("s2", datetime(2024, 1, 1))]


def test_bodies(spark):
    rows = [("a", HEAD + entry("u1", "2024") + entry("u2") + "</urlset>"), ("i", "<sitemapindex><sitemap><loc>a</loc></sitemap></sitemapindex>"),
            ("one", "<urlset>" + entry("u9") + "</urlset>"), ("none", "<urlset></urlset>"), ("bad", "<urlset><url><loc>u"), ("null", None)]
    read = parse_sitemaps(spark.createDataFrame(rows, "url string, body string")).collect()
    assert sorted((r.sitemap, r.kind, r.url or "") for r in read) == [
        ("a", "url", "u1"), ("a", "url", "u2"), ("bad", "corrupt", ""), ("i", "sitemap", "a"), ("null", "corrupt", ""), ("one", "url", "u9"),
    ]


def cut(text):
    return [f" {w} "[i : i + 3] for w in re.findall("[a-z0-9]+", (text or "").lower()) for i in range(len(w))]


def brute(categories, titles, intent):
    runs = {}
    for name, slug in categories:
        runs.setdefault(slug, []).extend(cut(f"{name or ''} {slug}"))
    for slug, title in titles:
        runs.setdefault(slug, []).extend(cut(title))
    mean = sum(map(len, runs.values())) / len(runs)
    scores = {}
    for g in set(cut(intent)):
        held = [s for s in runs if g in runs[s]]
        for s in held:
            n = runs[s].count(g)
            weight = math.log(1 + (len(runs) - len(held) + 0.5) / (len(held) + 0.5))
            scores[s] = scores.get(s, 0) + weight * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(runs[s]) / mean))
    return scores


def test_ranked_intent(spark):
    categories = [("Exam Gloves", "exam-gloves"), ("Mirrors", "mirrors"), (None, "impression"), ("Anesthetics", "anesthetics")]
    titles = [("exam-gloves", "Nitrile glove, powder free"), ("mirrors", "Mouth mirror #5"), ("impression", "Alginate powder"), ("impression", None), ("mirrors", "")]
    shown = spark.createDataFrame([(*c, "kept") for c in categories], "name string, slug string, gram string")
    listed = spark.createDataFrame(titles, "slug string, title string")
    got = {r.slug: r.score for r in intent_scores(shown, listed, "anesthetic and glove").collect()}
    assert got == pytest.approx(brute(categories, titles, "anesthetic and glove"))

    def best(intent):
        return [r.slug for r in rank_by_intent(shown, listed, intent).orderBy(F.desc("score")).collect()]

    assert best("anasthetic")[0] == "anesthetics" and best("alginates") == ["impression"] and best("nitril GLOVE") == ["exam-gloves"]
    assert best("qqqq") == [] and len(best(" ")) == len(best(None)) == 4
    assert set(best("gloves, mirrors")) == {"exam-gloves", "mirrors"}
    assert rank_by_intent(shown.limit(0), listed.limit(0), "gloves").count() == 0
    assert spark.range(1).select(grams(F.lit("Ab c")).alias("g")).first().g == [" ab", "ab ", " c "]


def test_variants_stay_aligned(spark):
    data = '{"a":{"sku":"1","position":2},"b":{"manufacturer_part_number":"M","manufacturer_name":"X","position":1},"c":5}'
    html = '<script>window.masterData = "' + data.replace('"', "\\u0022") + '";</script>'
    found = extract_variants(spark.createDataFrame([("u", html), ("v", "nothing"), ("w", None)], "url string, html string"))
    assert [tuple(r) for r in found.orderBy("place").collect()] == [("u", 0, 1, None, "M", "X"), ("u", 1, 2, "1", None, None)]
    assert spark.range(1).select(master_data_text(F.lit(html)) != "").first()[0]


def test_a_fact_across_a_border_is_whole_in_one_prompt(spark):
    site = replace(SiteConfig(), fallback_html_chars=50, fallback_overlap_chars=12)
    rows = [(f"u{k}", "x" * k + "price 12.34" + "y" * 60, ["price"]) for k in range(95)] + [("short", "price 12.34", ["price"]), ("exact", "z" * 39 + "price 12.34", ["price"])]
    asked = build_fallback_requests(spark.createDataFrame(rows, "url string, html string, missing array<string>"), site).collect()
    assert {r.url for r in asked if "price 12.34" in r.prompt} == {r[0] for r in rows}
    assert {r.parts for r in asked if r.url in ("short", "exact")} == {1}
    shown = {(r.url, r.part_no): r.prompt.split(":\n", 1)[1] for r in asked}
    assert all(len(s) <= 50 for s in shown.values())
    for url, html, _ in rows:
        parts = [shown[url, k] for k in range(sum(u == url for u, _ in shown))]
        assert parts[0] + "".join(p[12:] for p in parts[1:]) == html
