"""Incremental processing with Structured Streaming."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from catalogspark.plans.cascade import read_static, route_outcomes
from catalogspark.sources.store import KeyedTable

# Workers get this module's Python function with the query, whether or not they have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_extract(page_stream: DataFrame) -> DataFrame:
    """First-tier extraction of arriving pages: stateless, so it is the batch plan on a stream."""
    return read_static(page_stream)


def stream_upsert(
    extracted: DataFrame, products: KeyedTable, states: KeyedTable, at: Column, seq: str, checkpoint: str
) -> StreamingQuery:
    """Upsert products and states per micro-batch, from ``stream_extract`` rows, until input runs out.

    Batches are stored under their id and the checkpoint's name, so a batch that is run again after a failure
    replaces itself and nothing else.
    ``seq`` orders the rows of a batch; ``category`` must be among the columns.
    """

    writer = writer_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            new_products, new_states = route_outcomes(batch, at, extra=(seq,))
            products.write_batch(new_products, batch_id, seq, writer)
            states.write_batch(new_states, batch_id, seq, writer)
        finally:
            batch.unpersist()

    query = extracted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()


def writer_of(checkpoint: str) -> str:
    """A stream's name as a writer: batch ids count per checkpoint, so the checkpoint is the writer."""
    return f"stream-{hashlib.md5(checkpoint.rstrip('/').encode()).hexdigest()[:16]}"


def stream_latest(rows: DataFrame, key: str, seq: str | list[str]) -> DataFrame:
    """The last write of each key so far by ``seq``, whichever writer sent it and in whatever order rows arrive.

    The state of a key is its highest sequence and the row that came with it, so a row that arrives late does not undo a later
    one. Rows are reduced per key in every task before the shuffle, so a hot key is no hot spot. In update mode a micro-batch
    gives the keys that it touched. The state holds one row per key, as the table does. NULL sequences lose to all others.
    """
    order = [seq] if isinstance(seq, str) else list(seq)
    place = F.struct(*order)
    row = F.struct(*[F.col(c) for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(row, place).alias("_row")).select(key, "_row.*")


def stream_last_writes(rows: DataFrame, table: KeyedTable, seq: str | list[str], checkpoint: str) -> StreamingQuery:
    """Keep ``table`` at the last write of each key by ``seq`` until input runs out; several streams may be united into ``rows``."""
    writer = writer_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.write_batch(batch, batch_id, seq, writer)

    query = stream_latest(rows, table.key, seq).writeStream.outputMode("update").foreachBatch(write)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _earliest_per_batch(at: str):
    """The earliest row of each URL in every Arrow batch."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = batch.select(["url", at]).to_pandas().sort_values(at, kind="stable")
            kept = times.drop_duplicates("url").index
            yield batch.take(pa.array(sorted(kept)))

    return thin


class _FirstArrival(StatefulProcessor):
    """State of a URL: its earliest time, until ``millis`` of event time after it."""

    def __init__(self, at: str, millis: int):
        self.at, self.millis = at, millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = min(part[self.at].min() for part in rows)
        known = self.first.get() if self.first.exists() else None
        if known is None or earliest < pd.Timestamp(known[0]):
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.first.update((earliest.to_pydatetime(),))
            self.handle.registerTimer(int(earliest.timestamp() * 1000) + self.millis)
            yield pd.DataFrame({"url": [key[0]], self.at: [earliest]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_first_seen(urls: DataFrame, at: str, within: timedelta) -> DataFrame:
    """(url, first time) of each URL as soon as it arrives, and again whenever an earlier arrival comes late.

    The last row of a URL is its first arrival: the minimum is kept in state, with a timer that forgets the URL ``within`` that
    event time after it, so the state does not grow with every URL ever seen; from then on the URL counts as new. Arrivals
    may be late by as much. Rows without URL or time are left out. Only the earliest row of each URL in an Arrow batch is shuffled, so a
    URL that arrives all the time is no hot spot. Needs the RocksDB state store (``configure_state``) and update mode.
    """
    arrivals = urls.select("url", F.col(at).cast("timestamp").alias(at)).where(F.col("url").isNotNull() & F.col(at).isNotNull())
    thinned = arrivals.mapInArrow(_earliest_per_batch(at), arrivals.schema)
    millis = int(within.total_seconds() * 1000)
    grouped = thinned.withWatermark(at, f"{millis} milliseconds").groupBy("url")
    return grouped.transformWithStateInPandas(_FirstArrival(at, millis), thinned.schema, "update", "eventTime")


def configure_state(spark: SparkSession) -> SparkSession:
    """The state store that keyed state with timers needs; queries take it from the session when they start."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    return spark


FIRST_SEEN_SCHEMA = StructType([StructField("url", StringType(), False), StructField("first_seen", TimestampType(), False)])


def stream_first_seen_into(urls: DataFrame, at: str, within: timedelta, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Keep ``table`` (of ``FIRST_SEEN_SCHEMA``) at the first arrival of each URL until input runs out."""
    writer = writer_of(checkpoint)
    configure_state(urls.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.write_batch(batch.withColumnRenamed(at, "first_seen"), batch_id, "first_seen", writer)

    query = stream_first_seen(urls, at, within).writeStream.outputMode("update").foreachBatch(write)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to parquet files until its input runs out."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
