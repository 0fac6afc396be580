"""Rules the products table must keep, reported instead of enforced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.schemas import AVAILABILITIES, METHODS, STATUSES

NOT_NULL = ("sku", "name", "product_url", "category_path", "extracted_at", "extraction_method")
UNIQUE = ("sku", "product_url")
STATE_NOT_NULL = ("url", "category", "status", "updated_at")
DOMAINS = {"extraction_method": METHODS, "availability": AVAILABILITIES}


def check_constraints(products: DataFrame) -> DataFrame:
    """Violations as (rule, column, value, n): unique keys, required values, value domains.

    Row rules are checked in one scan; unique keys are counted with partial sums, so a value
    that many rows share is no hot spot.
    """
    return _violations(products, NOT_NULL, DOMAINS, UNIQUE)


def check_state_constraints(states: DataFrame) -> DataFrame:
    """``check_constraints`` for the crawl states: one row per URL, required values, known statuses."""
    return _violations(states, STATE_NOT_NULL, {"status": STATUSES}, ("url",))


def _violations(products: DataFrame, required: tuple, domains: dict, unique: tuple) -> DataFrame:
    checks = []
    for name in [c for c in required if c in products.columns]:
        checks.append(F.when(F.col(name).isNull(), _broken("not_null", name, F.lit(None))))
    for name, domain in domains.items():
        if name in products.columns:
            checks.append(F.when(~F.col(name).isin(*domain), _broken("domain", name, F.col(name))))
    found = products.select(F.explode(F.array_compact(F.array(*checks))).alias("v")).select("v.*")
    violations = found.groupBy("rule", "column", "value").agg(F.count("*").alias("n"))
    for name in unique:
        counts = products.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value"))
        repeated = counts.agg(F.count("*").alias("n")).where("n > 1")
        labelled = repeated.select(F.lit("unique").alias("rule"), F.lit(name).alias("column"), "value", "n")
        violations = violations.unionByName(labelled)
    return violations


def _broken(rule: str, column: str, value):
    return F.struct(
        F.lit(rule).alias("rule"), F.lit(column).alias("column"), value.cast("string").alias("value")
    )
