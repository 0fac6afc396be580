"""URL shapes: what a link points at and its canonical form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.functions.text import strip
from catalogspark.site import SiteConfig


def _without_end_slash(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def canonical_category_url(url: Column, site: SiteConfig) -> Column:
    """Absolute category URL without end slash; NULL for any other link or a reserved slug."""
    trimmed = strip(url)
    absolute = F.when(F.startswith(trimmed, F.lit("/")), F.concat(F.lit(site.base), trimmed)).otherwise(trimmed)
    clean = _without_end_slash(absolute)
    reserved = last_segment(clean).isin(*site.reserved_slugs) if site.reserved_slugs else F.lit(False)
    return F.when(absolute.rlike(site.category_url_pattern) & ~reserved, clean)


def canonical_product_url(url: Column, site: SiteConfig) -> Column:
    """Absolute product URL without end slash; NULL for any other link."""
    return stripped_product_url(strip(url), site)


def stripped_product_url(trimmed: Column, site: SiteConfig) -> Column:
    """``canonical_product_url`` of a text without white space at its ends."""
    relative = F.startswith(trimmed, F.lit(site.product_prefix + "/"))
    absolute = F.when(relative, F.concat(F.lit(site.base), trimmed)).otherwise(trimmed)
    return F.when(absolute.rlike(site.product_url_pattern), _without_end_slash(absolute))


def normalize_url(url: Column, site: SiteConfig) -> Column:
    """Absolute form of a recommended link; '' for anything that is no link."""
    trimmed = strip(url)
    return (
        F.when(F.startswith(trimmed, F.lit("//")), F.concat(F.lit("https:"), trimmed))
        .when(F.startswith(trimmed, F.lit(site.product_prefix + "/")), F.concat(F.lit(site.base), trimmed))
        .when(trimmed.rlike("^https?://"), trimmed)
        .otherwise("")
    )


def category_address(slug: Column, site: SiteConfig) -> Column:
    """Category URL of a slug, a nested slug or a full URL."""
    full = slug.rlike("^https?://")
    nested = F.btrim(slug, F.lit("/"))
    return F.when(full, _without_end_slash(slug)).otherwise(
        F.concat(F.lit(f"{site.base}{site.category_prefix}/"), nested)
    )


def page_type(url: Column, site: SiteConfig) -> Column:
    """``category``, ``product`` or ``other`` by the shape of the URL."""
    return (
        F.when(url.rlike(site.category_url_pattern), "category")
        .when(url.rlike(site.product_url_pattern), "product")
        .otherwise("other")
    )
