"""What makes one record of a product better than another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogspark.functions.text import is_blank, is_empty, nonblank, strip
from catalogspark.schemas import METHODS

UNKNOWN_METHOD_RANK = 99


def method_rank(method: Column) -> Column:
    """0 for the most trusted extraction method, 99 for an unknown one."""
    rank = F.lit(UNKNOWN_METHOD_RANK)
    for i, name in enumerate(METHODS):
        rank = F.when(method == name, i).otherwise(rank)
    return rank


def completeness(
    brand: Column, pack_size: Column, specifications: Column, alternatives: Column, images: Column
) -> Column:
    """0 to 5: one point per filled field, and one for more than one image."""
    filled = [
        ~is_blank(brand),
        ~is_blank(pack_size),
        ~is_empty(specifications),
        ~is_empty(alternatives),
        F.coalesce(F.size(images) > 1, F.lit(False)),
    ]
    score = F.lit(0)
    for f in filled:
        score = score + f.cast("int")
    return score


def completeness_of_product() -> Column:
    """``completeness`` over the columns of the products table."""
    return completeness(*map(F.col, ("brand", "pack_size", "specifications", "alternative_products", "image_urls")))


def dedupe_key(sku: Column, product_url: Column) -> Column:
    """The trimmed SKU, or the product URL when the SKU is blank."""
    return F.coalesce(nonblank(strip(sku)), product_url)
