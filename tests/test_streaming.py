import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from catalogspark.sources.store import KeyedTable, products_table, states_table
from catalogspark.streaming.incremental import FIRST_SEEN_SCHEMA, stream_extract, stream_first_seen_into, stream_last_writes, stream_upsert


def at():
    return F.lit("2024-06-01").cast("timestamp")


def page(sku, name, price="1.00"):
    return f'<script type="application/ld+json">{json.dumps({"@type": "Product", "sku": sku, "name": name, "offers": {"price": price}})}</script>'


def arrive(spark, folder, rows):
    df = spark.createDataFrame(rows, "url string, category string, html string, fetch_error string, seq long")
    df.coalesce(1).write.mode("append").parquet(str(folder))
    return df.schema


def test_upserts_over_several_runs(spark, tmp_path):
    incoming, checkpoint = tmp_path / "in", str(tmp_path / "check")
    products = products_table(spark, str(tmp_path / "products"))
    states = states_table(spark, str(tmp_path / "states"))

    def run(schema):
        stream = stream_extract(spark.readStream.schema(schema).parquet(str(incoming)))
        stream_upsert(stream, products, states, at(), "seq", checkpoint).awaitTermination()

    schema = arrive(spark, incoming, [("u", "c", page("A", "one"), None, 1), ("v", "c", None, "HTTP 500", 2), ("w", "c", page("A", "two"), None, 3)])
    run(schema)
    assert {r.sku: r.name for r in products.read().collect()} == {"A": "two"}
    assert {r.url: (r.status, r.error) for r in states.read().collect()} == {"u": ("done", None), "v": ("failed", "static fetch: HTTP 500"), "w": ("done", None)}
    arrive(spark, incoming, [("v", "c", page("B", "late"), None, 4), ("x", "c", "<p>", None, 5)])
    run(schema)
    run(schema)  # nothing new
    assert {r.sku: r.name for r in products.read().collect()} == {"A": "two", "B": "late"}
    found = {r.url: (r.status, r.sku, r.error) for r in states.read().collect()}
    assert found["v"] == ("done", "B", None) and found["x"][0] == "failed" and len(found) == 4


def test_first_seen_over_micro_batches(spark, tmp_path):
    incoming, start = tmp_path / "in", datetime(2024, 1, 1)
    table = KeyedTable(spark, str(tmp_path / "out"), FIRST_SEEN_SCHEMA, "url")

    def arrivals(**minutes):
        rows = [(u, None if m is None else start + timedelta(minutes=m)) for u, times in minutes.items() for m in times]
        df = spark.createDataFrame([*rows, (None, start)], "url string, at timestamp")
        df.coalesce(1).write.mode("append").parquet(str(incoming))
        stream = spark.readStream.schema(df.schema).parquet(str(incoming))
        stream_first_seen_into(stream, "at", timedelta(days=1), table, str(tmp_path / "check")).awaitTermination()
        return {r.url: (r.first_seen - start).total_seconds() / 60 for r in table.read().collect()}

    assert arrivals(a=[5, 3, 9], b=[7], n=[None]) == {"a": 3, "b": 7}
    assert arrivals(a=[4], b=[2], c=[8, 8]) == {"a": 3, "b": 2, "c": 8}
    assert arrivals(b=[-30], d=[5000]) == {"a": 3, "b": -30, "c": 8, "d": 5000}
    # by now the URL is forgotten: it counts as new
    assert arrivals(e=[5001])["a"] == 3
    assert arrivals(a=[5002])["a"] == 5002


def test_last_writes_of_interleaved_writers(spark, tmp_path):
    schema = StructType([StructField("k", StringType()), StructField("name", StringType()), StructField("seq", LongType())])
    table = KeyedTable(spark, str(tmp_path / "t"), schema, "k")

    def run(a, b):
        sources = []
        for name, rows in (("a", a), ("b", b)):
            spark.createDataFrame([(k, f"{name}{s}", s) for k, s in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            sources.append(spark.readStream.schema(schema).parquet(str(tmp_path / name)))
        stream_last_writes(sources[0].union(sources[1]), table, "seq", str(tmp_path / "check")).awaitTermination()
        return {r.k: r.name for r in table.read().collect()}

    assert run([("x", 0), ("y", 5)], [("x", 1), ("z", None)]) == {"x": "b1", "y": "a5", "z": "bNone"}
    assert run([("x", 2)], [("y", 3)]) == {"x": "a2", "y": "a5", "z": "bNone"}  # y's late row does not undo the later one
    assert run([("z", 0)], [("x", 1)]) == {"x": "a2", "y": "a5", "z": "a0"}


def test_arrivals_are_built_by_all_tasks(spark):
    """Rows that come as files are written by as many tasks as hold them."""
    from pyspark.sql import functions as F

    from workloads.table_queries import _in_files

    rows = spark.range(0, 80, 1, 8).select("id", F.col("id").cast("timestamp").alias("at"))
    _, path = _in_files(spark, rows, 2, F.col("id") % 2)
    assert len(spark.read.parquet(f"{path}/0").inputFiles()) == 8
