"""Tables of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.text import is_blank
from catalogspark.functions.urls import page_type
from catalogspark.schemas import PAGE_SCHEMA
from catalogspark.site import SiteConfig


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages, one row per URL; ``fetch_error`` says why ``html`` is missing."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def fetch_failures(pages: DataFrame) -> DataFrame:
    """URL and error text of the pages whose fetch failed."""
    failed = pages.where(F.col("fetch_error").isNotNull())
    return failed.select("url", F.concat(F.lit("static fetch: "), "fetch_error").alias("error"))


def classify_pages(pages: DataFrame, site: SiteConfig = SiteConfig()) -> DataFrame:
    """Add ``page_type``: category, product or other, from the shape of the URL alone."""
    return pages.withColumn("page_type", page_type(F.col("url"), site))


def build_fallback_requests(incomplete: DataFrame, site: SiteConfig = SiteConfig()) -> DataFrame:
    """Requests for a model, for each page with missing fields: url, part_no, parts, missing, prompt.

    Needs url, html and missing. A prompt shows at most ``site.fallback_html_chars`` characters. A longer page
    is asked about in several parts, numbered from 0, which together show all of it. Neighbouring parts share
    ``site.fallback_overlap`` characters, so a fact of up to that length is whole in one of them.
    """
    budget, overlap = site.fallback_html_chars, site.fallback_overlap
    step = budget - overlap
    asked = incomplete.where((F.size("missing") > 0) & ~is_blank(F.col("html")))
    parts = F.greatest(F.ceil((F.length("html") - overlap) / step), F.lit(1)).cast("int")
    asked = asked.select("url", "missing", "html", parts.alias("parts"))
    asked = asked.withColumn("part_no", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return asked.select(
        "url",
        "part_no",
        "parts",
        "missing",
        F.format_string(
            "Page: %s\nFill in: %s\nHTML, part %s of %s:\n%s",
            "url",
            F.array_join("missing", ", "),
            F.col("part_no") + 1,
            "parts",
            F.substring("html", F.col("part_no") * step + 1, F.lit(budget)),
        ).alias("prompt"),
    )
