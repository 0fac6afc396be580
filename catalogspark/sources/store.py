"""The products and crawl-state tables: upserts and their storage as plain parquet."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from catalogspark.operators.ordering import latest_by_key
from catalogspark.schemas import PRODUCT_SCHEMA, STATE_SCHEMA


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """All products in SKU order."""
    return spark.read.schema(PRODUCT_SCHEMA).parquet(path).orderBy("sku")


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(path)


def replace_rows(existing: DataFrame, rows: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """``existing`` with ``rows`` in place of those with the same key. Both hold each key once.

    ``existing`` is only probed, so few keys leave it unshuffled. ``keys`` may give the same keys,
    repeated or not, from a cheaper source than ``rows``.
    """
    given = (rows if keys is None else keys).select(key)
    kept = existing.join(given, key, "left_anti").select(*existing.columns)
    return kept.unionByName(rows.select(*existing.columns))


def upsert(existing: DataFrame, batch: DataFrame, key: str, seq: str | list[str]) -> DataFrame:
    """``existing`` with every row of ``batch`` inserted or, by key, replaced as a whole.

    Within the batch the last row by ``seq`` wins. The batch is read twice, so it should be a stored
    table rather than a long computation.
    """
    return replace_rows(existing, latest_by_key(batch, key, seq), key, keys=batch)


def upsert_products(existing: DataFrame, batch: DataFrame, seq: str | list[str]) -> DataFrame:
    """Insert or overwrite every column on SKU conflict; the last processed record wins."""
    return upsert(existing, batch, "sku", seq)


def upsert_states(existing: DataFrame, batch: DataFrame, seq: str | list[str]) -> DataFrame:
    """Insert or overwrite by URL; NULLs overwrite too, so success clears an error and vice versa."""
    return upsert(existing, batch, "url", seq)


def bulk_upsert_products(
    existing: DataFrame, records: DataFrame, seq: str | list[str]
) -> tuple[DataFrame, DataFrame]:
    """Upserted products, and one row ``n``: the number of records given (not of distinct SKUs)."""
    return upsert_products(existing, records, seq), records.agg(F.count("*").alias("n"))


def make_state(
    url: Column, category: Column, status: Column, sku: Column, error: Column, updated_at: Column
) -> list[Column]:
    """The columns of a crawl-state row."""
    values = (url, category, status, sku, error, updated_at)
    return [v.cast(f.dataType).alias(f.name) for v, f in zip(values, STATE_SCHEMA)]


class KeyedTable:
    """A keyed table as one Parquet table with a partition for each batch; reading keeps the last write per key.

    Every batch is stored with a commit number, one more than the highest of the table when the batch was first written, whoever wrote
    it. So of several writers, such as streams and batch jobs, the one that wrote a key last counts. A batch
    that is written again keeps its number and replaces just its own partition: replays are harmless and change no order. Batches that
    start at the same moment may share a number; then the writer's name decides. ``compact`` folds the batches
    into one when reading gets slow.
    """

    COMMIT, WRITER, BATCH = "commit", "writer", "batch_id"

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key
        marks = [StructField(self.COMMIT, LongType()), StructField(self.WRITER, StringType()), StructField(self.BATCH, LongType())]
        self._stored = StructType([*schema.fields, *marks])
        spark.createDataFrame([], self._stored).write.mode("ignore").parquet(path)

    def rows(self) -> DataFrame:
        """All stored rows with their commit, writer and batch."""
        return self.spark.read.schema(self._stored).parquet(self.path)

    def commit_of(self, batch_id: int, writer: str) -> int:
        """The number that a batch has, or that it gets now; only partition values are read."""
        same = (F.col(self.WRITER) == writer) & (F.col(self.BATCH) == batch_id)
        own, last = F.max(F.when(same, F.col(self.COMMIT))), F.max(self.COMMIT)
        return self.rows().agg(F.coalesce(own, last + 1, F.lit(1))).first()[0]

    def write_batch(self, rows: DataFrame, batch_id: int, seq: str | list[str], writer: str = "batch") -> None:
        """Store the last row per key by ``seq`` as one batch of a writer."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", writer):
            raise ValueError("a writer's name consists of letters, digits, dots, dashes and underscores")
        winners = latest_by_key(rows, self.key, seq).select(*self.schema.fieldNames())
        marks = {self.COMMIT: self.commit_of(batch_id, writer), self.WRITER: writer, self.BATCH: batch_id}
        marked = winners.withColumns({name: F.lit(value) for name, value in marks.items()})
        _overwrite(marked, self.path, list(marks))

    def read(self) -> DataFrame:
        marks = [self.COMMIT, self.WRITER, self.BATCH]
        return latest_by_key(self.rows(), self.key, marks).drop(*marks)

    def compact(self, path: str) -> KeyedTable:
        """A copy at a new path with all batches folded into one; later writes count after it."""
        target = KeyedTable(self.spark, path, self.schema, self.key)
        target.write_batch(self.read(), 0, self.key, "compacted")
        return target


def _overwrite(rows: DataFrame, path: str, partitions: list[str]) -> None:
    """Write rows into their partitions of a table, in place of what these held; other partitions stay."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).parquet(path)


_VERSIONS = StructType([StructField("version", LongType())])


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of what has been published below ``path``."""
    spark.createDataFrame([], _VERSIONS).write.mode("ignore").parquet(f"{path}/published")
    found = spark.read.schema(_VERSIONS).parquet(f"{path}/published").distinct().collect()
    return sorted(r["version"] for r in found)


def publish(path: str, **tables: DataFrame) -> int:
    """Store tables together as the next version below ``path``, and return its number.

    Each table has a partition per version. The version's number is added to the table ``published`` last, so readers, who look
    there first, switch from all old tables to all new ones. A table may be made from the version that it follows.
    There is one publisher at a time; what a failed one left is overwritten.
    """
    spark = next(iter(tables.values())).sparkSession
    number = max(versions(spark, path), default=0) + 1
    for name, table in tables.items():
        _overwrite(table.withColumn("version", F.lit(number).cast("long")), f"{path}/{name}", ["version"])
    spark.range(1).select(F.lit(number).cast("long").alias("version")).write.mode("append").parquet(f"{path}/published")
    return number


def read_published(spark: SparkSession, path: str, name: str, schema: StructType, version: int | None = None) -> DataFrame:
    """A table of the latest published version, or of a given one; empty if nothing was published yet."""
    found = versions(spark, path)
    if version is None and not found:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(StructType([*schema.fields, *_VERSIONS.fields])).parquet(f"{path}/{name}")
    return stored.where(F.col("version") == (found[-1] if version is None else version)).drop("version")


def products_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, PRODUCT_SCHEMA, "sku")


def states_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, STATE_SCHEMA, "url")
