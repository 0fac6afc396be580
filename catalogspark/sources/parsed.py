"""Parsed blocks of pages as a stored table, from which products are extracted again without the HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalogspark.plans.extraction import page_blocks


def store_blocks(pages: DataFrame, path: str) -> None:
    """Store the blocks of pages as Parquet, JSON-LD entities as VARIANT, in place of what is there; ``html`` itself is not stored."""
    page_blocks(pages).write.mode("overwrite").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Stored blocks, for ``partial_of_blocks``; an empty table of pages gives an empty one."""
    return spark.read.parquet(path)
