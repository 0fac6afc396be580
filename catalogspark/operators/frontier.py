"""Which URLs are to be processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def urls_by_status(states: DataFrame, *statuses: str) -> DataFrame:
    """States with one of the statuses in URL order; none given, none returned."""
    return states.where(F.col("status").isin(*statuses) if statuses else F.lit(False)).orderBy("url")


def get_state(states: DataFrame, url: str) -> DataFrame:
    """The state of one URL; no row if it was never seen."""
    return states.where(F.col("url") == url)


def with_prior_status(listed: DataFrame, states: DataFrame) -> DataFrame:
    """Add ``prior_status``, NULL for a URL without state. States hold each URL once."""
    return listed.join(states.select("url", F.col("status").alias("prior_status")), "url", "left")


def needs_work(prior_status: Column) -> Column:
    return prior_status.isNull() | (prior_status != "done")


def select_frontier(listed: DataFrame, states: DataFrame) -> DataFrame:
    """Listed URLs that are not done: new ones, and every other status for another try."""
    frontier = with_prior_status(listed, states).where(needs_work(F.col("prior_status")))
    return frontier.withColumn("is_new", F.col("prior_status").isNull())


def refresh_frontier(listing: DataFrame, products: DataFrame, as_of: Column, n_days: int) -> DataFrame:
    """Products to extract again: changed since extraction, or extracted more than ``n_days`` ago.

    Needs (url, lastmod) and (product_url, extracted_at). URLs without a product are new, not stale,
    and are left to ``select_frontier``. Of several products with one URL the last extraction counts.
    """
    known = products.groupBy(F.col("product_url").alias("url")).agg(F.max("extracted_at").alias("extracted_at"))
    changed = F.col("lastmod") > F.col("extracted_at")
    old = F.col("extracted_at") < as_of - F.make_interval(days=F.lit(n_days))
    reason = F.when(changed, "changed").when(old, "old")
    return listing.join(known, "url").withColumn("reason", reason).where(F.col("reason").isNotNull())
