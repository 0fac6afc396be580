"""Replies of a recommendation service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.jsonld import strict_json


def _list_of_objects(v: Column) -> Column:
    """Objects of a JSON list; entries of any other type are skipped but keep their position."""
    return F.transform(
        F.try_variant_get(v, "$", "array<variant>"),
        lambda e: F.when(F.startswith(F.schema_of_variant(e), F.lit("OBJECT<")), e),
    )


def _text(v: Column, path: str) -> Column:
    """Text at a path if it is a string."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))


def explode_recs(payloads: DataFrame) -> DataFrame:
    """One row per recommended product of (sku, payload): sku, unit_pos, product_pos, rec_sku, rec_url.

    Malformed levels of the payload are skipped; the service's order stays in the two positions.
    """
    results = F.try_variant_get(strict_json(F.col("payload")), "$.results", "variant")
    units = payloads.select("sku", F.posexplode(_list_of_objects(results)).alias("unit_pos", "unit"))
    products = units.select(
        "sku",
        "unit_pos",
        F.posexplode(_list_of_objects(F.try_variant_get("unit", "$.products", "variant"))).alias(
            "product_pos", "product"
        ),
    ).where(F.col("product").isNotNull())
    return products.select(
        "sku",
        "unit_pos",
        "product_pos",
        F.try_variant_get("product", "$.sku", "string").alias("rec_sku"),
        _text(F.col("product"), "$.url").alias("rec_url"),
    )
