"""What the physical plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from catalogspark.functions.inline import with_master_data
from catalogspark.functions.jsonld import jsonld_blocks, jsonld_entities, with_product_jsonld
from catalogspark.operators.discovery import canonical_product_urls
from catalogspark.operators.dedupe import dedupe_products
from catalogspark.operators.ordering import first_n, first_seen, latest_by_key
from catalogspark.plans.cascade import fallback_requests, read_static, resolve_tiers, with_copy_key
from catalogspark.plans.catalog_job import with_place
from catalogspark.plans.extraction import extract_partial
from catalogspark.session import BROADCAST_ESTIMATE, bound_broadcasts, new_dir
from catalogspark.sources.listings import readable_pages
from catalogspark.sources.store import upsert_products
from workloads import inputs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, df, path):
    df.write.mode("overwrite").parquet(str(path))
    return spark.read.schema(df.schema).parquet(str(path))


@pytest.fixture
def part(spark):
    return inputs.table(spark, SF, "part")


@pytest.fixture
def pages(spark, part, tmp_path):
    return stored(spark, inputs.product_pages(part), tmp_path / "pages")


def test_extraction_is_narrow_and_reads_blocks_once(pages):
    text = plan(extract_partial(pages).where(F.size("missing") > 0).where("method = 'dom'"))
    assert "Exchange" not in text
    assert text.count("application/ld\\+json") == 1
    assert text.count("window\\.masterData") == 1
    assert text.count("ArrowEvalPython") == 2  # one trip for markup and entities, one for entities that were escaped twice
    assert re.search(r"ReadSchema: struct<.*html:string", text)


def test_extraction_reads_only_what_is_asked(pages):
    text = plan(extract_partial(pages).select("url", "partial.sku"))
    assert "fetch_error" not in re.search(r"ReadSchema: (.*)", text).group(1)



def test_only_pages_that_are_needed_are_read(spark, part, pages, tmp_path):
    static = stored(spark, read_static(pages), tmp_path / "static")
    rendered = stored(spark, inputs.rendered_pages(part), tmp_path / "rendered")
    answers = stored(spark, inputs.fallback_replies(part), tmp_path / "answers")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (resolve_tiers(static, rendered, answers), fallback_requests(static, pages, rendered)):
            text = plan(df)
            # children stand below their parents: each parsing of HTML is above the semi-join with what is incomplete
            assert 0 < text.index("ArrowEvalPython") < text.index("LeftSemi")
            assert text.count("LeftSemi") == 1
            assert sum("html" in re.split(r"[#, 0-9L]+", names) for names in shuffle_outputs(df)) == 1
        assert "ArrowEvalPython" not in plan(fallback_requests(static, pages))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # few incomplete pages are broadcast, and then no HTML moves
    assert not any("html" in re.split(r"[#, 0-9L]+", names) for names in shuffle_outputs(resolve_tiers(static, rendered, answers)))


def test_replies_are_parsed_once(spark):
    replies = stored(spark, inputs.listing_replies(inputs.table(spark, SF, "lineitem")), new_dir(spark, "replies"))
    df = readable_pages(replies)
    assert "payload" not in plan(df)


def shuffle_outputs(df):
    """Column names that cross each shuffle."""
    formatted = df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", formatted)


@pytest.mark.parametrize("operator", ["first_seen", "latest_by_key", "dedupe"])
def test_hot_keys_are_pruned_before_the_shuffle(spark, operator):
    lineitem = inputs.table(spark, SF, "lineitem")
    df = {
        "first_seen": lambda: first_seen(lineitem, "l_partkey", inputs.SEEN),
        "latest_by_key": lambda: latest_by_key(lineitem, "l_partkey", inputs.SEEN),
        "dedupe": lambda: dedupe_products(inputs.observations(lineitem), inputs.SEEN),
    }[operator]()
    text = plan(df)
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")
    assert text.count("Exchange") == 1


def test_large_caps_spread_a_hot_key(spark):
    text = plan(first_n(inputs.listing_hits(inputs.table(spark, SF, "lineitem")), "category", inputs.SEEN, 2000))
    shuffles = re.findall(r"hashpartitioning\((.*?), \d+\)", text)
    assert len(shuffles) == 2 and "_salt" in shuffles[1] and "_salt" not in shuffles[0]


def test_a_small_batch_leaves_the_store_unshuffled(spark, part, tmp_path):
    existing = stored(spark, inputs.prior_products(part), tmp_path / "existing")
    batch = stored(spark, inputs.prior_products(part).limit(5).withColumn("seq", F.lit(1)), tmp_path / "batch")
    text = plan(upsert_products(existing, batch, "seq"))
    assert "BroadcastHashJoin" in text and "LeftAnti" in text
    assert text.count("Exchange hashpartitioning") == 1  # the batch's own


def test_filter_on_products_reads_pages_once(spark):
    """A filter on the product goes below no shuffle with the parsing of the page."""
    built = inputs.product_pages(inputs.parts(spark, SF)).select("position", jsonld_entities(F.col("html")).alias("e"))
    text = plan(with_product_jsonld(built, "e", "p").where("p IS NOT NULL"))
    assert text.count("application/ld\\+json") == 1
    assert text.index("application/ld\\+json") < text.index("Exchange")


def test_variant_data_is_parsed_once(spark, pages):
    """The literal and its object are each parsed in one place, however often the functions above mention them."""
    text = plan(with_master_data(pages.select("url", F.col("html").alias("t")), "t", "m"))
    assert text.count("from_json(") == 2


def test_blocks_are_parsed_once(pages):
    assert plan(pages.select(jsonld_blocks(F.col("html")))).count("parseJson") == 1


def test_links_are_stripped_once(spark):
    hits = inputs.listing_hits(inputs.table(spark, SF, "lineitem"))
    assert plan(canonical_product_urls(hits, keys=("category", "url"), order=inputs.SEEN)).count("trim(") <= 3


@pytest.fixture
def thresholds(spark):
    """The thresholds of broadcasts, by estimate and by measure, as the session has them by default; put back afterwards."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.unset(name)
    yield names
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_records_of_pages_are_not_broadcast(spark, part, pages, tmp_path, thresholds):
    """Their estimated size is so far below the true one that any threshold would let them through."""
    static = stored(spark, read_static(pages), tmp_path / "static")
    rendered = stored(spark, inputs.rendered_pages(part), tmp_path / "rendered")
    answers = stored(spark, inputs.fallback_replies(part), tmp_path / "answers")
    later = plan(resolve_tiers(static, rendered, answers))
    assert later.count("SortMergeJoin") == 2 and not re.search("BroadcastHashJoin.*LeftOuter", later)
    work = stored(spark, pages.select("url", "position"), tmp_path / "work")
    first = plan(with_place(read_static(with_copy_key(pages, "url", "html", "fetch_error")), work))
    assert "SortMergeJoin" in first and "Broadcast" not in first
    assert first.count("Exchange hashpartitioning") == 2  # the picks and the join share one


def test_estimates_have_a_lower_threshold_for_broadcasts(spark, thresholds):
    estimated, measured = thresholds
    for _ in range(2):
        bound_broadcasts(spark)
        assert (spark.conf.get(estimated), spark.conf.get(measured)) == (str(BROADCAST_ESTIMATE), "10485760b")
    spark.conf.set(estimated, "-1")
    bound_broadcasts(spark)
    assert spark.conf.get(estimated) == "-1"


def test_records_of_all_pages_are_merged_with_answers(spark, thresholds):
    text = plan(queries()["merge_fallback"](spark, SF))
    assert text.count("SortMergeJoin") == 1 and "Broadcast" not in text


def executions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {found.apply(i).executionId(): found.apply(i).physicalPlanDescription() for i in range(found.size())}


@pytest.mark.parametrize("name", ["catalog_run_states", "catalog_run_from_landing_page", "catalog_run_products", "catalog_run_stats", "published_run"])
def test_no_step_of_a_run_broadcasts_records(spark, thresholds, name):
    """Lists of keys may be broadcast if they are short, what was extracted from pages never is."""
    before = executions(spark)
    queries()[name](spark, SF).collect()
    plans = [text for number, text in executions(spark).items() if number not in before]
    sent = [columns for text in plans for columns in re.findall(r"\) BroadcastExchange\nInput \[\d+\]: \[(.*?)\]\n", text)]
    assert len(plans) > 4 and sent
    assert not [columns for columns in sent if re.search(r"\b(r_partial|partial|answer)#", columns)]
