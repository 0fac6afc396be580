"""Counts, rates and health reports over products and crawl states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.text import nonblank, strip
from catalogspark.operators.ordering import first_n
from catalogspark.operators.rolling import rolling_mean

# Rates that a healthy catalog keeps.
MIN_JSON_LD_RATE = 0.95
MAX_FALLBACK_RATE = 0.10

# Kinds of failure, tried in this order on the error text.
FAILURE_KINDS = (
    ("5xx", r"(?i)\b5\d\d\b|server error|bad gateway|service unavailable"),
    ("timeout", r"(?i)time[d]?[ -]?out"),
    ("parse", r"(?i)required fields missing|pars|json|decode"),
    ("fetch", r"(?i)fetch|connect|\b4\d\d\b"),
)


def status_counts(states: DataFrame) -> DataFrame:
    """Number of URLs per status, in status order."""
    return states.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


def product_count(products: DataFrame) -> DataFrame:
    return products.agg(F.count("*").alias("n"))


def status_report(products: DataFrame, states: DataFrame) -> DataFrame:
    """Product total and status histogram as (section, name, n)."""
    total = product_count(products).select(F.lit("products").alias("section"), F.lit("total").alias("name"), "n")
    by_status = states.groupBy("status").agg(F.count("*").alias("n"))
    return total.unionByName(by_status.select(F.lit("crawl_state").alias("section"), F.col("status").alias("name"), "n"))


def brand_mode(variants: DataFrame, key: str, brand: str, order) -> DataFrame:
    """Most frequent non-blank brand per key; of equally frequent ones the first seen.

    Brands are counted before they are compared, so a key with many variants shrinks to its brands.
    """
    named = variants.withColumn("brand", nonblank(strip(F.col(brand)))).where(F.col("brand").isNotNull())
    order = [F.col(c) if isinstance(c, str) else c for c in ([order] if isinstance(order, (str, Column)) else order)]
    counted = named.groupBy(key, "brand").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return first_n(counted, key, [F.desc("n"), "first", "brand"], 1).select(key, "brand", "n")


def _method_share(name: str) -> Column:
    return F.avg((F.col("extraction_method") == name).cast("int"))


def method_rates(products: DataFrame, by: str | None = None) -> DataFrame:
    """Share of each extraction method, overall or per ``by``, with alerts on the healthy rates."""
    grouped = products.groupBy(by) if by else products.groupBy()
    rates = grouped.agg(
        F.count("*").alias("products"),
        _method_share("json_ld").alias("json_ld_rate"),
        _method_share("dom").alias("dom_rate"),
        _method_share("playwright_dom").alias("playwright_dom_rate"),
        _method_share("llm_fallback").alias("llm_fallback_rate"),
    )
    return rates.withColumn("low_json_ld", F.col("json_ld_rate") < MIN_JSON_LD_RATE).withColumn(
        "high_llm_fallback", F.col("llm_fallback_rate") > MAX_FALLBACK_RATE
    )


def failure_kind(error: Column) -> Column:
    kind = F.lit("other")
    for name, pattern in reversed(FAILURE_KINDS):
        kind = F.when(error.rlike(pattern), name).otherwise(kind)
    return kind


def failure_buckets(states: DataFrame) -> DataFrame:
    """Failed URLs per kind of error."""
    failed = states.where(F.col("status") == "failed")
    return failed.groupBy(failure_kind(F.col("error")).alias("kind")).agg(F.count("*").alias("n"))


def category_health(
    states: DataFrame, products: DataFrame, baseline: DataFrame | None = None, spike: float = 2.0
) -> DataFrame:
    """Failure rate and fallback rate per category; a spike is ``spike`` times the baseline rate.

    ``baseline`` is this report of an earlier run (category, failure_rate, fallback_rate).
    """
    failures = states.groupBy("category").agg(
        F.count("*").alias("urls"), F.avg((F.col("status") == "failed").cast("int")).alias("failure_rate")
    )
    fallbacks = products.groupBy(F.col("source_category").alias("category")).agg(
        F.count("*").alias("products"), _method_share("llm_fallback").alias("fallback_rate")
    )
    health = failures.join(fallbacks, "category", "left")
    if baseline is None:
        return health
    before = baseline.select(
        "category",
        F.col("failure_rate").alias("base_failure_rate"),
        F.col("fallback_rate").alias("base_fallback_rate"),
    )
    return health.join(before, "category", "left").withColumns(
        {
            "failure_spike": F.coalesce(F.col("failure_rate") > spike * F.col("base_failure_rate"), F.lit(False)),
            "fallback_spike": F.coalesce(F.col("fallback_rate") > spike * F.col("base_fallback_rate"), F.lit(False)),
        }
    )


def sample_for_review(products: DataFrame, key: str = "sku", percent: int = 10) -> DataFrame:
    """A repeatable sample: the same keys are drawn in every run, by the first digits of their MD5."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return products.where(number % 100 < percent)


def quality_rolling_mean(
    scores: DataFrame, at: str, tie_break: list[str], preceding: int, chunk_rows: int = 100_000
) -> DataFrame:
    """Rolling mean of judge scores per source category and method.

    Needs source_category, extraction_method and score.
    """
    groups = ["source_category", "extraction_method"]
    return rolling_mean(scores, groups, at, tie_break, "score", preceding, chunk_rows)
