"""Best record per product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.ranking import completeness_of_product, dedupe_key, method_rank
from catalogspark.operators.ordering import first_n


def dedupe_products(
    records: DataFrame,
    seen: str | Column | Sequence[str | Column],
    score: Column | None = None,
) -> DataFrame:
    """Keep the best record per SKU, or per URL where the SKU is blank.

    Better is: a more trusted method, then more filled fields, then newer, then seen earlier.
    ``score`` replaces the completeness of the product columns.
    """
    seen = [seen] if isinstance(seen, (str, Column)) else list(seen)
    score = completeness_of_product() if score is None else score
    best_first = [method_rank(F.col("extraction_method")), score.desc(), F.col("extracted_at").desc(), *seen]
    return first_n(records, dedupe_key(F.col("sku"), F.col("product_url")), best_first, 1)


def deduped_count(records: DataFrame) -> DataFrame:
    """How many records ``dedupe_products`` keeps: one per key, so no record needs comparing."""
    key = dedupe_key(F.col("sku"), F.col("product_url"))
    return records.select(key.alias("key")).distinct().agg(F.count("*").alias("kept"))
