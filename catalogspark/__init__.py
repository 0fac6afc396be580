"""Curated product tables from tables of crawled pages."""

from catalogspark.plans.cascade import route_outcomes, run_cascade
from catalogspark.plans.catalog_job import CatalogInputs, CatalogRun, run_catalog_job
from catalogspark.plans.extraction import build_records, extract_partial
from catalogspark.session import configure
from catalogspark.site import SiteConfig

__all__ = [
    "CatalogInputs",
    "CatalogRun",
    "SiteConfig",
    "build_records",
    "configure",
    "extract_partial",
    "route_outcomes",
    "run_cascade",
    "run_catalog_job",
]
