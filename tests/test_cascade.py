"""Extraction tiers and the whole run."""

import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from catalogspark.plans.cascade import route_outcomes, run_cascade
from catalogspark.plans.catalog_job import CatalogInputs, run_catalog_job
from catalogspark.plans.extraction import build_records, extract_partial, merge_fallback
from catalogspark.schemas import PRODUCT_SCHEMA, STATE_SCHEMA
from catalogspark.site import SiteConfig
from catalogspark.sources.answers import parse_fallback_answers
from catalogspark.sources.pages import build_fallback_requests

B = SiteConfig().base

def at():
    return F.lit("2024-06-01").cast("timestamp")
NOTHING = "<p>words and no product</p>"
ANSWER = {
    "sku": "Q77", "name": "Lamp shade", "brand": "Umbra Works", "price": "7.05", "currency": "USD", "availability": "on request",
    "pack_size": "12/case", "description": " folds flat ", "specifications": {" Fits ": "E14 ", "Fits": "E27"},
    "image_urls": ["https://pics.example.com/q77.png"], "alternative_products": ["https://other.example.com/product/bulb", ""], "category_path": ["Lamps"],
}


def page(sku="K", name="Plain chair", price="88.2", extra="", **fields):
    product = {"@type": "Product", "sku": sku, "name": name, "offers": {"price": price}} | fields
    return f'<script type="application/ld+json">{json.dumps(product)}</script>{extra}'


def pages(spark, **html):
    rows = [(f"{B}/product/{k}", "cat", None if k.startswith("lost") else v, v if k.startswith("lost") else None) for k, v in html.items()]
    return spark.createDataFrame(rows, "url string, category string, html string, fetch_error string")


def texts(spark, column, **values):
    return spark.createDataFrame([(f"{B}/product/{k}", v) for k, v in values.items()], f"url string, {column} string")


def by_url(df):
    return {r.url.rsplit("/", 1)[-1]: r for r in df.collect()}


def test_markup_and_variant_data_add_to_jsonld(spark):
    variants = '{"a":{"sku":"1","manufacturer_part_number":"M","manufacturer_name":"Maker"}}'.replace('"', "\\u0022")
    extra = f'<script>window.masterData = "{variants}"</script><div class="product-pack-size">9/box</div>'
    rows = by_url(extract_partial(pages(spark, a=page(extra=extra, brand="Seller", description="50 per box"), b=page(description="50 per box"),
                                        c=page(price="0"), d=NOTHING, e=extra, lost="HTTP 500")))
    assert (rows["a"].partial.brand, rows["a"].partial.pack_size, rows["a"].partial.item_numbers) == ("Maker", "9/box", ["1"])
    assert rows["b"].partial.pack_size == "50/box" and rows["b"].partial.image_urls == []
    assert rows["c"].missing == ["price"] and rows["c"].method == "json_ld"
    assert rows["d"].missing == ["name", "price", "sku"] and rows["d"].method == "dom"
    assert rows["e"].method == "json_ld" and rows["e"].partial.image_urls is None
    assert rows["lost"].method == "dom"


def test_records_have_defaults(spark):
    read = extract_partial(pages(spark, a=page(name=" N ", url=""), b=NOTHING))
    record = build_records(read, at(), F.col("category")).first()
    assert record.asDict() | {"extracted_at": None} == {
        "sku": "K", "item_numbers": [], "mfr_numbers": [], "name": "N", "product_url": f"{B}/product/a", "category_path": [], "brand": None,
        "price": Decimal("88.2"), "price_text": "88.2", "currency": None, "availability": None, "pack_size": None, "description": "",
        "specifications": {}, "image_urls": [], "alternative_products": [], "extracted_at": None, "extraction_method": "json_ld",
        "source_category": "cat",
    }
    assert record.extracted_at == datetime(2024, 6, 1)


@pytest.mark.parametrize("content", ["", "no json", "[1]", '{"sku": "x"} I hope this helps', None])
def test_replies_without_an_object_are_empty(spark, content):
    row = parse_fallback_answers(texts(spark, "content", a=content)).first()
    assert row.answer is not None and all(v is None for v in row.answer)


def test_fences_are_removed(spark):
    fenced = texts(spark, "content", a='```json\n{"sku":"1"}\n```', b='  ```{"sku":"1"}```', c='```JSON {"sku":"1","price":7,"image_urls":"x"}```')
    found = by_url(parse_fallback_answers(fenced))
    assert [found[k].answer.sku for k in "abc"] == ["1"] * 3
    assert found["c"].answer.price == "7" and found["c"].answer.image_urls is None


def test_answers_fill_only_gaps(spark):
    read = extract_partial(pages(spark, a=page(price=None, sku="", image=[]), b=page(price="0")))
    joined = read.join(parse_fallback_answers(texts(spark, "content", a=json.dumps(ANSWER), b=json.dumps(ANSWER))), "url")
    loose = by_url(joined.select("url", merge_fallback(F.col("partial"), F.col("answer")).alias("m")))
    strict = by_url(joined.select("url", merge_fallback(F.col("partial"), F.col("answer"), strict=True).alias("m")))
    a = loose["a"].m
    assert (a.sku, a.name, a.price, a.price_text, a.category_path) == ("Q77", "Plain chair", Decimal("7.05"), "7.05", ["Lamps"])
    assert a.image_urls == ["https://pics.example.com/q77.png"] and strict["a"].m.image_urls == []
    assert loose["b"].m.price == 0  # a price of 0 is a value, though it does not count as a price


def test_tiers_with_rendering(spark):
    static = pages(spark, good=page("G"), rendered=NOTHING, asked=page("S", price=None), failed=NOTHING, unseen=page("U", price=None),
                   blank=NOTHING, lost="HTTP 503")
    rendered = texts(spark, "html", rendered=page("R", name="Rendered"), asked=page("T", price=None), failed=NOTHING, blank="", good=page("X"))
    answers = texts(spark, "content", asked=json.dumps(ANSWER), failed="{}", unseen=json.dumps(ANSWER))
    outcomes = run_cascade(static, rendered, answers)
    rows = by_url(outcomes)
    assert {k: (r.method, r.partial.sku if r.error is None else None) for k, r in rows.items()} == {
        "good": ("json_ld", "G"), "rendered": ("playwright_dom", "R"), "asked": ("llm_fallback", "T"), "failed": ("llm_fallback", None),
        "unseen": ("json_ld", None), "blank": ("dom", None), "lost": ("dom", None),
    }
    assert rows["failed"].error == "required fields missing after LLM fallback: ['name', 'price', 'sku']"
    assert rows["unseen"].error == "required fields missing without LLM fallback: ['price']"
    assert rows["lost"].error == "static fetch: HTTP 503"
    products, states = route_outcomes(outcomes, at())
    assert {r.sku for r in products.collect()} == {"G", "R", "T"}
    found = by_url(states)
    assert (found["asked"].status, found["asked"].sku, found["asked"].error) == ("done", "T", None)
    assert (found["failed"].status, found["failed"].sku) == ("failed", None)


def test_tiers_without_rendering(spark):
    static = pages(spark, good=page("G"), asked=NOTHING, failed=page("F", price=None), lost="x")
    rows = by_url(run_cascade(static, answers=texts(spark, "content", asked=json.dumps(ANSWER))))
    assert rows["asked"].method == "llm_fallback" and rows["asked"].error is None
    record, _ = route_outcomes(run_cascade(static, answers=texts(spark, "content", asked=json.dumps(ANSWER))), at())
    asked = record.where("sku = 'Q77'").first()
    assert (asked.availability, asked.description, asked.specifications) == ("Unknown", "folds flat", {"Fits": "E27"})
    assert asked.alternative_products == ["https://other.example.com/product/bulb"] and asked.category_path == ["Lamps"]
    assert rows["failed"].error == "required fields missing after LLM fallback: ['price']"
    assert run_cascade(static).where("error IS NULL").count() == 1


def test_a_function_answers_only_what_is_still_incomplete(spark):
    static = pages(spark, good=page("G"), asked=NOTHING, shown=NOTHING, unseen=NOTHING, lost="x")
    rendered = texts(spark, "html", asked=page("T", price=None), shown=page("R"), good=page("X", price=None))
    seen = []

    def ask(requests):
        seen.append([(r.url.rsplit("/", 1)[-1], r.missing) for r in requests.collect()])
        return requests.select("url", F.lit(json.dumps(ANSWER)).alias("content"))

    rows = by_url(run_cascade(static, rendered, ask))
    assert seen == [[("asked", ["price"])]]
    assert {k for k, r in rows.items() if r.error is None} == {"good", "asked", "shown"}
    rows = by_url(run_cascade(static, answers=ask))
    assert sorted(k for k, _ in seen[1]) == ["asked", "shown", "unseen"]
    assert {k for k, r in rows.items() if r.error is None} == {"good", "asked", "shown", "unseen"}


def test_requests_name_what_is_missing(spark):
    site = SiteConfig(fallback_html_chars=30)
    df = spark.createDataFrame([("u", "x" * 40, ["price"]), ("v", "short", ["sku"]), ("w", "y", [])], "url string, html string, missing array<string>")
    rows = {(r.url, r.part_no): r for r in build_fallback_requests(df, site).collect()}
    assert set(rows) == {("u", 0), ("u", 1), ("v", 0)} and {k: r.parts for k, r in rows.items()} == {("u", 0): 2, ("u", 1): 2, ("v", 0): 1}
    assert rows["u", 0].prompt.endswith("\n" + "x" * 30) and rows["u", 1].prompt.endswith("\n" + "x" * 10)
    assert "Fill in: price" in rows["u", 0].prompt


def listing(spark, **urls):
    rows = [(c, 0, json.dumps({"results": [{"hits": [{"url": f"{B}/product/{u}"} for u in us], "nbPages": 1}]})) for c, us in urls.items()]
    return spark.createDataFrame(rows, "category string, page_no int, payload string")


def inputs(spark, listed, static, states=(), **more):
    names = sorted({r.category for r in listed.select("category").collect()})
    categories = spark.createDataFrame([(None, f"/catalog/{n}", i) for i, n in enumerate(names)], "name string, url string, position long")
    at = datetime(2024, 1, 1)
    known = spark.createDataFrame([(f"{B}/product/{u}", "earlier", s, k, None, at) for u, s, k in states], STATE_SCHEMA)
    return CatalogInputs(categories, listed, static, spark.createDataFrame([], PRODUCT_SCHEMA), known, **more)


def test_run_counts_like_a_sequential_run(spark):
    listed = listing(spark, a=["good", "needs", "broken", "done", "later"], b=["good", "broken", "again", "done"])
    static = pages(spark, good=page("G"), needs=NOTHING, broken=NOTHING, again=page("A"), done=page("D"), unlisted=page("X"))
    rendered = texts(spark, "html", needs=page("R"), broken=NOTHING)
    given = inputs(spark, listed, static, [("done", "done", "D"), ("again", "failed", None)], rendered=rendered)
    run = run_catalog_job(given, at())
    assert run.stats.first().asDict() == {
        "discovered_categories": 2, "discovered": 4, "extracted_jsonld": 2, "extracted_playwright": 1, "extracted_llm": 0,
        "failed": 2, "skipped_done": 3,
    }
    states = by_url(run.states)
    assert {k: (r.status, r.category) for k, r in states.items()} == {
        "good": ("done", "a"), "needs": ("done", "a"), "broken": ("failed", "b"), "done": ("done", "earlier"), "again": ("done", "b"),
        "later": ("discovered", "a"),
    }
    assert {r.sku: r.source_category for r in run.products.collect()} == {"G": "a", "R": "a", "A": "b"}


def test_run_caps_apply_before_the_skip(spark):
    listed = listing(spark, a=["one", "two"], b=["three"], c=["four"])
    static = pages(spark, one=page("1"), two=page("2"), three=page("3"), four=page("4"))
    given = inputs(spark, listed, static, [("one", "done", "1")])
    run = run_catalog_job(given, at(), max_categories=2, max_products_per_category=1)
    assert [r.slug for r in run.categories.orderBy("position").collect()] == ["a", "b"]
    stats = run.stats.first()
    assert (stats.discovered_categories, stats.skipped_done, stats.extracted_jsonld) == (2, 1, 1)
    assert {r.sku for r in run.products.collect()} == {"3"}
    assert {r.slug for r in run_catalog_job(given, at(), intent="C please").categories.collect()} == {"c"}


def test_rerun_finds_nothing_to_do(spark):
    listed = listing(spark, a=["one", "two"])
    static = pages(spark, one=page("1"), two=page("2", price=None))
    first = run_catalog_job(inputs(spark, listed, static), at())
    again = inputs(spark, listed, static)
    again = CatalogInputs(again.categories, listed, static, first.products, first.states)
    second = run_catalog_job(again, at())
    stats = second.stats.first()
    assert (stats.discovered, stats.skipped_done, stats.extracted_jsonld, stats.failed) == (0, 1, 0, 1)
    assert second.products.count() == 1 and second.states.count() == 2


def test_later_url_wins_a_shared_sku_and_recs_are_attached(spark):
    listed = listing(spark, a=["one", "two"], b=["three"])
    static = pages(spark, one=page("S", name="first"), two=page("S", name="second"), three=page("T"))
    recs = spark.createDataFrame([("S", json.dumps({"results": [{"products": [{"sku": "Q", "url": "/product/q"}]}]}))], "sku string, payload string")
    run = run_catalog_job(inputs(spark, listed, static, recs_payloads=recs), at())
    rows = {r.sku: r for r in run.products.collect()}
    assert rows["S"].name == "second" and rows["S"].alternative_products == [f"{B}/product/q"] and rows["T"].alternative_products == []
    assert {r.status for r in run.states.collect()} == {"done"}


def test_copies_of_a_page_count_once(spark):
    """A third of the fetched rows are copies of one page; the last fetched of them counts."""
    listed = listing(spark, a=["hot", "one"])
    static = pages(spark, one=page("1"), hot=page("old")).withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp"))
    copies = spark.range(60).select(
        F.lit(f"{B}/product/hot").alias("url"), F.lit("cat").alias("category"),
        F.when(F.col("id") == 41, page("last")).otherwise(NOTHING).alias("html"), F.lit(None).cast("string").alias("fetch_error"),
        F.when(F.col("id") == 41, "2024-03-01").otherwise("2024-02-01").cast("timestamp").alias("fetched_at"),
    )
    others = static.where("url LIKE '%/one'").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("n")
    rendered = texts(spark, "html", one=page("R")).unionByName(texts(spark, "html", one=page("R")))
    run = run_catalog_job(inputs(spark, listed, static.unionByName(copies).unionByName(others), rendered=rendered), at())
    stats = run.stats.first()
    assert (stats.discovered, stats.extracted_jsonld, stats.failed, stats.skipped_done) == (2, 2, 0, 0)
    assert {r.sku for r in run.products.collect()} == {"last", "1"} and run.states.count() == 2


def test_repeated_renderings_and_answers_do_not_repeat_rows(spark):
    static = pages(spark, asked=page("S", price=None))
    rendered = texts(spark, "html", asked=page("T", price=None))
    answers = texts(spark, "content", asked=json.dumps(ANSWER))
    outcomes = run_cascade(static, rendered.unionByName(rendered), answers.unionByName(answers).unionByName(answers))
    assert outcomes.count() == 1 and outcomes.first().error is None
