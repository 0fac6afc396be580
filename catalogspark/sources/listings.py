"""Category listings: the search settings a category page carries and the replies of that search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.functions.text import is_empty
from catalogspark.operators.ordering import first_n
from catalogspark.operators.rolling import row_numbers
from catalogspark.schemas import LISTING_REPLY_SCHEMA
from catalogspark.session import materialize, once
from catalogspark.site import SiteConfig

# Where a category page names the settings of its product search.
APPLICATION_ID = r'"applicationId"\s*:\s*"([A-Za-z0-9]+)"'
INDEX_NAME = r'"indexName"\s*:\s*"([A-Za-z0-9_]+)"'
API_KEY = r'"apiKey"\s*:\s*"([A-Za-z0-9+/=]+)"'
CATEGORY_ID = r'"category_id"\s*:\s*"(\d+)"'
PRODUCTS_INDEX_SUFFIX = "_products"


def listing_config(html: Column) -> Column:
    """Search settings of a category page as a struct; NULL unless all four are there."""
    app, index, key, category = (
        F.regexp_extract(html, pattern, 1) for pattern in (APPLICATION_ID, INDEX_NAME, API_KEY, CATEGORY_ID)
    )
    return F.when(
        (app != "") & (index != "") & (key != "") & (category != ""),
        F.struct(
            app.alias("application_id"),
            key.alias("api_key"),
            F.concat(index, F.lit(PRODUCTS_INDEX_SUFFIX)).alias("products_index"),
            category.alias("category_id"),
        ),
    )


def extract_listing_config(pages: DataFrame) -> DataFrame:
    """URL and search settings of each category page."""
    return pages.select("url", listing_config(F.col("html")).alias("config"))


def filter_listing(hits: DataFrame, category_id: str | Column) -> DataFrame:
    """Indexed products that a category shows: member of the category and visible in the catalog."""
    return hits.where(F.array_contains("categoryIds", category_id) & (F.col("visibility_catalog") == 1))


def filter_listing_by_categories(hits: DataFrame, categories: DataFrame) -> DataFrame:
    """``filter_listing`` for a table of categories (category_id, category) at once."""
    visible = hits.where(F.col("visibility_catalog") == 1)
    member = visible.withColumn("category_id", F.explode(F.array_distinct("categoryIds")))
    return member.join(categories, "category_id")


def page_listing(hits: DataFrame, site: SiteConfig = SiteConfig(), order="rank") -> DataFrame:
    """Number the hits of each category (``hit_no`` from 1, ``page`` from 0) as pages of the search.

    With a cap, the pages past it are cut, and ``hit_page_cap`` marks categories with more than that.
    """
    if site.listing_max_pages is None:
        first, *rest = [order] if isinstance(order, str) else order
        ranked = row_numbers(hits, ["category"], first, rest).withColumnRenamed("row_no", "hit_no")
        page = F.floor((F.col("hit_no") - 1) / site.hits_per_page)
        return ranked.withColumn("page", page).withColumn("hit_page_cap", F.lit(False))
    limit = site.hits_per_page * site.listing_max_pages
    ranked = first_n(hits, "category", order, limit, rank_as="hit_no")
    page = F.floor((F.col("hit_no") - 1) / site.hits_per_page)
    sizes = hits.groupBy("category").agg(F.count("*").alias("hits"))
    capped = sizes.select("category", (F.col("hits") > limit).alias("hit_page_cap"))
    return ranked.withColumn("page", page).join(capped, "category")


def readable_pages(listing_pages: DataFrame, site: SiteConfig = SiteConfig()) -> DataFrame:
    """The reply pages a page-by-page reader gets to see, with ``result`` in place of ``payload``.

    Needs category, page_no and payload; other columns are kept.

    Reading a category ends after the page that the reply calls the last, before the first page that
    is missing, failed (NULL payload) or without results, and at the page cap if there is one. Each
    reply is parsed once, and stored without its text.
    """
    cap = site.listing_max_pages
    # In brackets, because the parser would ignore what follows a whole reply.
    replies = F.from_json(F.concat(F.lit("["), "payload", F.lit("]")), T.ArrayType(LISTING_REPLY_SCHEMA))
    reply = F.when(F.size("_replies") == 1, F.col("_replies")[0])
    kept = [c for c in listing_pages.columns if c != "payload"]
    numbered = F.col("page_no") >= 0 if cap is None else F.col("page_no").between(0, cap - 1)
    parsed = once(listing_pages.where(numbered), kept, _replies=replies)
    pages = materialize(parsed.select(*kept, F.get(reply["results"], F.lit(0)).alias("result")), "listing-replies")
    good = pages.where(F.col("result").isNotNull())
    last = F.col("page_no") + 1 >= F.coalesce("result.nbPages", F.col("page_no") + 1)
    read = good.groupBy("category", "page_no").agg(F.max(last).alias("last"))
    place = F.row_number().over(W.partitionBy("category").orderBy("page_no")) - 1
    ends = read.withColumn("place", place).groupBy("category").agg(
        F.min(F.when(F.col("last"), F.col("page_no") + 1)).alias("after_last"),
        F.min(F.when(F.col("page_no") != F.col("place"), F.col("place"))).alias("first_gap"),
        F.count("*").alias("read"),
    )
    ends = ends.select("category", F.least("after_last", F.coalesce("first_gap", "read")).alias("end"))
    return pages.join(ends, "category").where(F.col("page_no") < F.col("end")).drop("end")


def pages_past_cap(listing_pages: DataFrame, site: SiteConfig = SiteConfig()) -> DataFrame:
    """Categories that a page cap cuts, with the number of reply pages past it; none without a cap."""
    past = F.lit(False) if site.listing_max_pages is None else F.col("page_no") >= site.listing_max_pages
    return listing_pages.where(past).groupBy("category").agg(F.count_distinct("page_no").alias("pages_past_cap"))


def explode_listing(readable: DataFrame) -> DataFrame:
    """One row per hit with a URL: ``result`` gives way to hit_pos, url and pages, the reply's page count."""
    kept = [c for c in readable.columns if c != "result"]
    hits = readable.where(~is_empty(F.col("result.hits"))).select(
        *kept, F.col("result.nbPages").alias("pages"), F.posexplode("result.hits").alias("hit_pos", "hit")
    )
    return hits.where(F.col("hit.url") != "").select(*kept, "hit_pos", F.col("hit.url").alias("url"), "pages")
