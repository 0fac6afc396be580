"""The crawl states laid out for their readers: a partition per status, buckets by URL, bloom filters on the URL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from catalogspark.schemas import STATE_SCHEMA


def store_states(states: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """Store states (each URL once) as the table ``name`` with its files at ``path``, in place of what it held, and return it.

    - ``select_frontier`` and other joins on the URL read the buckets as they lie: only the other side is shuffled, into as many
      partitions.
    - ``urls_by_status`` opens the partitions of its statuses only.
    - ``get_state`` opens one bucket of each status, and skips the files whose bloom filter lacks the URL.

    Choose ``buckets`` so that one holds some hundred megabytes. The rows are dealt by bucket first, so each task writes one file per status.
    """
    rows = states.select(*STATE_SCHEMA.fieldNames()).repartition(buckets, "url")
    writer = rows.write.mode("overwrite").format("parquet").option("path", path)
    writer = writer.option("parquet.bloom.filter.enabled#url", "true").partitionBy("status").bucketBy(buckets, "url").sortBy("url")
    writer.saveAsTable(name)
    return states.sparkSession.table(name).select(*STATE_SCHEMA.fieldNames())
