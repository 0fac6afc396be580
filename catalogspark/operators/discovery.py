"""Categories and product URLs: discovery, canonical form, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.text import nonblank, strip
from catalogspark.functions.urls import (
    canonical_category_url,
    category_address,
    last_segment,
    normalize_url,
    stripped_product_url,
)
from catalogspark.operators.ordering import first_seen
from catalogspark.session import once
from catalogspark.site import SiteConfig


def canonical_categories(categories: DataFrame, site: SiteConfig = SiteConfig(), order="position") -> DataFrame:
    """Top-level categories with canonical URLs, the first of each; needs name, url and the order."""
    url = canonical_category_url(F.col("url"), site)
    kept = categories.withColumn("url", url).where(F.col("url").isNotNull())
    slug = last_segment(F.col("url"))
    named = kept.withColumn("slug", slug).withColumn("name", strip(F.coalesce(nonblank(F.col("name")), slug)))
    return first_seen(named, "url", order)


def canonical_product_urls(
    listed: DataFrame, site: SiteConfig = SiteConfig(), keys=("url",), order="position"
) -> DataFrame:
    """Rows with a product URL, in canonical form, the first per key; other rows are dropped."""
    kept = [c for c in listed.columns if c != "url"]
    # in steps of their own, as the form is tested and taken, each from several mentions of the stripped text
    trimmed = once(listed, kept, url=strip(F.col("url")))
    found = once(trimmed, kept, url=stripped_product_url(F.col("url"), site)).select(*listed.columns)
    return first_seen(found.where(F.col("url").isNotNull()), list(keys), order)


def normalized_links(links: DataFrame, site: SiteConfig = SiteConfig(), url: str = "url") -> DataFrame:
    """Recommended links in absolute form, '' for anything that is no link."""
    return links.withColumn(url, normalize_url(F.col(url), site))


def category_from_slug(slugs: DataFrame, site: SiteConfig = SiteConfig()) -> DataFrame:
    """Category (name, url, slug) of each given slug, nested slug or full URL."""
    url = category_address(F.col("slug"), site)
    deepest = last_segment(url)
    return slugs.select(
        *[c for c in slugs.columns if c not in ("slug", "url", "name")],
        deepest.alias("name"),
        url.alias("url"),
        deepest.alias("slug"),
    )


def union_links(modern: Column, legacy: Column) -> Column:
    """Links of both forms in one array: the modern ones first, then the legacy ones."""
    return F.concat(modern, legacy)


def category_links(html: Column, site: SiteConfig) -> Column:
    """Category URLs linked on a page; a legacy link gives the URL of its slug."""
    modern = F.regexp_extract_all(html, F.lit(site.category_link_pattern), F.lit(1))
    slugs = F.regexp_extract_all(html, F.lit(site.legacy_link_pattern), F.lit(1))
    legacy = F.transform(slugs, lambda s: F.concat(F.lit(f"{site.base}{site.category_prefix}/"), s))
    return union_links(modern, legacy)


def discover_categories(pages: DataFrame, site: SiteConfig = SiteConfig(), page_order: str = "position") -> DataFrame:
    """Categories linked on landing pages, in the order of pages and of links within a page.

    A sub-category link counts for its parent. Every page first drops its own repeated links, so
    navigation that is on all pages leaves each task only once. ``position`` is the pair (page, pos).
    """
    links = pages.select(
        F.col(page_order).cast("bigint").alias("page_order"),
        F.posexplode(F.array_distinct(category_links(F.col("html"), site))).alias("pos", "url"),
    )
    position = F.struct(F.col("page_order").alias("page"), "pos")
    raw = links.select(F.lit(None).cast("string").alias("name"), "url", position.alias("position"))
    return canonical_categories(raw, site).select("name", "url", "slug", "position")


def words_of(c: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(c), r"(?U)[^\p{Alnum}]+"), lambda w: w != "")


def filter_by_intent(categories: DataFrame, intent: str | None) -> DataFrame:
    """Categories that share a word with the intent; all of them when the intent is blank.

    Words are compared as written. ``intent.rank_by_intent`` also finds inflected and misspelt ones.
    """
    if intent is None or not intent.strip():
        return categories
    wanted = words_of(F.lit(intent))
    return categories.where(F.arrays_overlap(words_of(F.concat_ws(" ", "name", "slug")), wanted))


def attach_source_category(urls: DataFrame, categories: DataFrame) -> DataFrame:
    """Add ``source_category``, the slug of the category whose URL is in ``category_url``; NULL if there is none.

    Of several categories with one URL the first slug counts, so no row is lost or repeated.
    """
    slugs = categories.groupBy(F.col("url").alias("category_url")).agg(F.min("slug").alias("source_category"))
    return urls.join(slugs, "category_url", "left")
