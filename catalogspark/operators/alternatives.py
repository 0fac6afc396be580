"""Alternative products from recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.text import is_blank, is_empty
from catalogspark.functions.urls import normalize_url
from catalogspark.operators.ordering import first_n, first_seen
from catalogspark.site import SiteConfig


def top_alternatives(recs: DataFrame, k: int | None = None, site: SiteConfig = SiteConfig()) -> DataFrame:
    """The first ``k`` distinct links per SKU, in (unit, product) order, as (sku, alternatives).

    Needs the columns of ``explode_recs``. The SKU itself, products without SKU and non-links are
    left out. At least one link is kept, even for k = 0.
    """
    k = max(site.max_alternatives if k is None else k, 1)
    links = recs.where(~is_blank(F.col("sku")) & ~is_blank(F.col("rec_sku")) & (F.col("rec_sku") != F.col("sku")))
    links = links.select("sku", "unit_pos", "product_pos", normalize_url(F.col("rec_url"), site).alias("url"))
    order = ["unit_pos", "product_pos"]
    distinct = first_seen(links.where(F.col("url") != ""), ["sku", "url"], order)
    chosen = first_n(distinct, "sku", order, k, rank_as="rank")
    ranked = F.array_sort(F.collect_list(F.struct("rank", "url")))
    return chosen.groupBy("sku").agg(F.transform(ranked, lambda r: r["url"]).alias("alternatives"))


def attach_alternatives(products: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Replace ``alternative_products`` where the SKU has alternatives, keep it elsewhere."""
    recommended = F.when(~is_empty(F.col("alternatives")), F.col("alternatives"))
    joined = products.join(alternatives, "sku", "left")
    return joined.withColumn(
        "alternative_products", F.coalesce(recommended, F.col("alternative_products"))
    ).select(*products.columns)
