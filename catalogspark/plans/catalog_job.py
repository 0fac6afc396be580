"""A whole run: categories, listings, frontier, extraction, alternatives, upserts, statistics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.alternatives import attach_alternatives, top_alternatives
from catalogspark.operators.discovery import (
    canonical_categories,
    canonical_product_urls,
    category_from_slug,
    discover_categories,
    filter_by_intent,
)
from catalogspark.operators.frontier import needs_work, with_prior_status
from catalogspark.operators.ordering import cap_categories, cap_per_group, latest_by_key
from catalogspark.plans.cascade import (
    copy_order,
    given_answers,
    read_static,
    resolve_tiers,
    route_outcomes,
    with_copy_key,
    without_older_copies,
)
from catalogspark.schemas import PRODUCT_SCHEMA, STATE_SCHEMA
from catalogspark.session import bound_broadcasts, configure, materialize
from catalogspark.site import SiteConfig
from catalogspark.sources.listings import explode_listing, pages_past_cap, readable_pages
from catalogspark.sources.recs import explode_recs
from catalogspark.sources.store import make_state, publish, replace_rows


@dataclass(frozen=True)
class CatalogInputs:
    """Tables of a run. ``categories``: name, url, position; ``listing_pages``: category, page_no,
    payload; the others as their readers describe. ``rendered`` None means no rendering; ``answers``
    may be a function from fallback requests to their answers. Without ``categories`` they are those that
    ``landing_pages`` (position, html) link, or those that ``slugs`` (slug, position) name."""

    categories: DataFrame | None
    listing_pages: DataFrame
    pages: DataFrame
    products: DataFrame
    states: DataFrame
    rendered: DataFrame | None = None
    answers: DataFrame | Callable[[DataFrame], DataFrame] | None = None
    recs_payloads: DataFrame | None = None
    landing_pages: DataFrame | None = None
    slugs: DataFrame | None = None


@dataclass(frozen=True)
class CatalogRun:
    categories: DataFrame
    frontier: DataFrame
    outcomes: DataFrame
    products: DataFrame
    states: DataFrame
    stats: DataFrame
    cut_categories: DataFrame

    def publish(self, path: str) -> int:
        """Store products and states as the next version below ``path``; readers then see both of them."""
        return publish(path, products=self.products, states=self.states)


def start_categories(inputs: CatalogInputs, site: SiteConfig) -> DataFrame:
    """Name, url and position of the categories that a run starts from."""
    if inputs.categories is not None:
        return inputs.categories
    if inputs.landing_pages is not None:
        return discover_categories(inputs.landing_pages, site).select("name", "url", "position")
    return category_from_slug(inputs.slugs, site).select("name", "url", "position")


def list_occurrences(
    categories: DataFrame, listing_pages: DataFrame, site: SiteConfig, max_products: int | None
) -> DataFrame:
    """Capped (category, url) pairs in processing order: category, url, cat_pos, page_no, hit_pos."""
    order = ["page_no", "hit_pos"]
    chosen = categories.select(F.col("slug").alias("category"), F.col("position").alias("cat_pos"))
    # Joined as pages, of which there are far fewer than hits.
    hits = explode_listing(readable_pages(listing_pages.join(chosen, "category"), site))
    urls = canonical_product_urls(hits, site, keys=("cat_pos", "url"), order=order)
    capped = cap_per_group(urls, "cat_pos", order, max_products)
    return capped.select("category", "url", "cat_pos", *order)


def plan_frontier(occurrences: DataFrame, states: DataFrame) -> DataFrame:
    """One row per listed URL: occurrences, first and last category, place in the order, prior status.

    Listings that share a URL are folded with partial sums, so a URL listed everywhere is no hot spot.
    """
    place = F.struct("cat_pos", "page_no", "hit_pos", "category")
    per_url = occurrences.groupBy("url").agg(
        F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")
    )
    frontier = per_url.select(
        "url",
        "n",
        F.col("first.category").alias("category"),
        F.col("last.category").alias("last_category"),
        F.col("first.cat_pos").alias("cat_pos"),
        F.col("first.page_no").alias("page_no"),
        F.col("first.hit_pos").alias("hit_pos"),
    )
    return with_prior_status(frontier, states)


def with_place(fetched: DataFrame, work: DataFrame) -> DataFrame:
    """The last copy of each page of ``read_static``, with its row of the frontier.

    Copies are dropped before the shuffle on the URL, which the join then shares. The hint keeps the planner from a broadcast of the
    records, as its estimate of what is extracted from a page is hundreds of times too low.
    """
    latest = latest_by_key(fetched, "url", copy_order(fetched)).drop("fetched_at", "copy_key")
    return latest.hint("merge").join(work, "url")


def run_stats(frontier: DataFrame, outcomes: DataFrame, categories: DataFrame) -> DataFrame:
    """One row of counters, equal to those of a run that visits every occurrence in order.

    A URL that is done is skipped at each occurrence, a URL that succeeds now at all but its first,
    and one that fails is tried, and fails, at each.
    """
    ok = F.col("error").isNull()
    done = F.col("prior_status") == "done"
    counters = {
        "discovered_categories": (categories, F.lit(1)),
        "discovered": (frontier, F.when(F.col("prior_status").isNull(), 1)),
        "extracted_jsonld": (outcomes, F.when(ok & F.col("method").isin("json_ld", "dom"), 1)),
        "extracted_playwright": (outcomes, F.when(ok & (F.col("method") == "playwright_dom"), 1)),
        "extracted_llm": (outcomes, F.when(ok & (F.col("method") == "llm_fallback"), 1)),
        "failed": (outcomes, F.when(~ok, F.col("n"))),
        "skipped_done": (frontier, F.when(done, F.col("n"))),
        "repeats_done": (outcomes, F.when(ok, F.col("n") - 1)),
    }
    rows = None
    for table in (categories, frontier, outcomes):
        part = table.agg(
            *[
                (F.sum(value.cast("bigint")) if source is table else F.lit(None).cast("bigint")).alias(name)
                for name, (source, value) in counters.items()
            ]
        )
        rows = part if rows is None else rows.unionByName(part)
    totals = rows.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counters])
    return totals.withColumn("skipped_done", F.col("skipped_done") + F.col("repeats_done")).drop("repeats_done")


def run_catalog_job(
    inputs: CatalogInputs,
    at: Column,
    site: SiteConfig = SiteConfig(),
    intent: str | None = None,
    max_categories: int | None = None,
    max_products_per_category: int | None = None,
    max_alternatives: int = 8,
    choose_categories: Callable[[DataFrame, str | None], DataFrame] = filter_by_intent,
) -> CatalogRun:
    """Process every listed URL that is not done and return the new tables and the statistics.

    URLs whose page is not there yet are left as discovered, for a later run; of several copies of a
    page the last fetched counts. Pages without work are dropped before anything is read from their HTML.
    ``max_alternatives`` links are kept per product.
    """
    bound_broadcasts(configure(inputs.pages.sparkSession))
    categories = choose_categories(canonical_categories(start_categories(inputs, site), site), intent)
    categories = materialize(cap_categories(categories, max_categories), "categories")
    occurrences = list_occurrences(categories, inputs.listing_pages, site, max_products_per_category)
    frontier = materialize(plan_frontier(occurrences, inputs.states), "frontier")

    work = frontier.where(needs_work(F.col("prior_status")))
    wanted = inputs.pages.join(work.select("url"), "url", "left_semi")
    fetched = read_static(with_copy_key(without_older_copies(wanted), "url", "html", "fetch_error"))
    static = materialize(with_place(fetched, work), "static-tier")
    answers = given_answers(inputs.answers, static, inputs.pages, inputs.rendered, site)
    outcomes = resolve_tiers(static, inputs.rendered, answers, store=True)

    order = ("cat_pos", "page_no", "hit_pos")
    new_products, new_states = route_outcomes(
        outcomes, at, source_category=F.col("category"), failed_category=F.col("last_category"), extra=order
    )
    winners = latest_by_key(new_products, "sku", list(order)).select(*PRODUCT_SCHEMA.fieldNames())
    if inputs.recs_payloads is not None:
        winners = attach_alternatives(winners, top_alternatives(explode_recs(inputs.recs_payloads), max_alternatives, site))

    untouched = work.where(F.col("prior_status").isNull()).join(static.select("url"), "url", "left_anti")
    nothing = F.lit(None).cast("string")
    waiting = untouched.select(
        *make_state(F.col("url"), F.col("category"), F.lit("discovered"), nothing, nothing, at), *order
    )
    return CatalogRun(
        categories=categories,
        frontier=frontier,
        outcomes=outcomes,
        products=replace_rows(inputs.products, winners, "sku", keys=new_products),
        states=replace_rows(inputs.states.select(*STATE_SCHEMA.fieldNames()), new_states.unionByName(waiting), "url"),
        stats=run_stats(frontier, outcomes, categories),
        cut_categories=pages_past_cap(inputs.listing_pages, site),
    )
