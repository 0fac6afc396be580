"""What an operator has to know about the shop whose pages are processed."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class SiteConfig:
    """Address and URL shapes of one shop, and the caps of a run; None is no cap.

    ``fallback_html_chars`` is the size of one request; a longer page is asked about in several, of
    which each begins with the last ``fallback_overlap_chars`` of the one before. A fact of up to that size is whole in one. A request
    of less than twice that size has no room for an overlap.
    """

    base_url: str = "https://shop.example.com"
    host: str = "shop.example.com"
    category_prefix: str = "/catalog"
    product_prefix: str = "/product"
    reserved_slugs: tuple[str, ...] = ("category",)
    hits_per_page: int = 40
    listing_max_pages: int | None = None
    max_alternatives: int = 8
    fallback_html_chars: int = 60_000
    fallback_overlap_chars: int = 4_000

    @property
    def fallback_overlap(self) -> int:
        return self.fallback_overlap_chars if self.fallback_html_chars >= 2 * self.fallback_overlap_chars else 0

    @property
    def base(self) -> str:
        return self.base_url.rstrip("/")

    # URL patterns. A category slug starts with a letter or digit.
    @property
    def category_url_pattern(self) -> str:
        host, prefix = re.escape(self.host), re.escape(self.category_prefix)
        return rf"(?i)^https?://[^/]*{host}{prefix}/[a-z0-9][a-z0-9\-]*/?$"

    @property
    def product_url_pattern(self) -> str:
        host, prefix = re.escape(self.host), re.escape(self.product_prefix)
        return rf"(?i)^https?://[^/]*{host}{prefix}/[a-z0-9\-]+/?$"

    @property
    def category_link_pattern(self) -> str:
        host, prefix = re.escape(self.host), re.escape(self.category_prefix)
        return rf"(?i)(https?://[^/\s\"']*{host}{prefix}/[a-z0-9][a-z0-9\-]*)"

    @property
    def legacy_link_pattern(self) -> str:
        prefix = re.escape(self.category_prefix)
        return rf"(?i){prefix}/category/view/s/([a-z0-9][a-z0-9\-]*)/id/\d+"
