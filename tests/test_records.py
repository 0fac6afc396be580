"""Ranking, dedupe, upserts, constraints and exports of product records."""

import csv
import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from catalogspark.operators.constraints import check_constraints
from catalogspark.operators.dedupe import dedupe_products, deduped_count
from catalogspark.operators.frontier import get_state, refresh_frontier, select_frontier, urls_by_status
from catalogspark.operators.ordering import first_n, first_seen, latest_by_key
from catalogspark.schemas import PRODUCT_SCHEMA, STATE_SCHEMA
from catalogspark.sources.export import EXPORT_COLUMNS, export
from catalogspark.sources.store import (
    KeyedTable,
    bulk_upsert_products,
    products_table,
    read_products,
    upsert_products,
    upsert_states,
)


def product(sku, **fields):
    values = {
        "sku": sku, "item_numbers": ["1", "2"], "mfr_numbers": [], "name": f"N {sku}", "product_url": f"https://s.example.com/{sku}",
        "category_path": ["A", "B"], "brand": None, "price": Decimal("1.5000"), "price_text": "1.50", "currency": "USD",
        "availability": "InStock", "pack_size": None, "description": 'say "hi",\nthere', "specifications": {}, "image_urls": [],
        "alternative_products": [], "extracted_at": datetime(2024, 1, 2, 3, 4, 5), "extraction_method": "json_ld", "source_category": None,
    } | fields
    return tuple(values[f.name] for f in PRODUCT_SCHEMA.fields)


def products(spark, *rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema_with_seq())
    return df


def schema_with_seq():
    from pyspark.sql import types as T

    return T.StructType([*PRODUCT_SCHEMA.fields, T.StructField("seq", T.LongType())])


def kept(df):
    return dedupe_products(df, "seq").orderBy("seq").collect()


def test_trusted_method_beats_completeness(spark):
    rich = product("A", extraction_method="llm_fallback", brand="X", pack_size="1/box")
    assert [r.seq for r in kept(products(spark, rich, product("A"), product("A", extraction_method="odd", brand="X")))] == [1]


def test_completeness_then_age_then_first_seen(spark):
    rich = product("A", brand="X", specifications={"k": "v"}, image_urls=["1", "2"])
    assert [r.seq for r in kept(products(spark, product("A"), rich))] == [1]
    newer = product("A", extracted_at=datetime(2024, 2, 1))
    assert [r.seq for r in kept(products(spark, product("A"), newer))] == [1]
    assert [r.seq for r in kept(products(spark, product("A"), product("A")))] == [0]


def test_blank_sku_falls_back_to_the_url(spark):
    rows = [product("", product_url="u"), product(" ", product_url="u", brand="X"), product("", product_url="w"), product(" B "), product("B")]
    df = products(spark, *rows)
    assert [r.seq for r in kept(df)] == [1, 2, 3]
    assert deduped_count(df).first().kept == 3


def test_upsert_replaces_whole_rows_last_wins(spark):
    existing = products(spark, product("A", brand="old"), product("B")).drop("seq")
    batch = products(spark, product("A", brand="x"), product("C"), product("A", brand=None, name="last"))
    rows = {r.sku: r for r in upsert_products(existing, batch, "seq").collect()}
    assert set(rows) == {"A", "B", "C"}
    assert (rows["A"].name, rows["A"].brand) == ("last", None)
    again, n = bulk_upsert_products(existing, batch, "seq")
    assert n.first().n == 3 and again.count() == 3


def states(spark, *rows):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(u, "c", s, k, e, at) for u, s, k, e in rows], STATE_SCHEMA)


def test_state_upsert_clears_the_other_outcome(spark):
    existing = states(spark, ("u", "done", "K", None), ("v", "failed", None, "boom"), ("w", "done", "W", None))
    batch = states(spark, ("u", "failed", None, "late"), ("v", "done", "V", None)).withColumn("seq", F.lit(1))
    rows = {r.url: (r.status, r.sku, r.error) for r in upsert_states(existing, batch, "seq").collect()}
    assert rows == {"u": ("failed", None, "late"), "v": ("done", "V", None), "w": ("done", "W", None)}


def test_state_lookups_and_frontier(spark):
    known = states(spark, ("b", "done", "B", None), ("a", "failed", None, "e"), ("c", "discovered", None, None))
    assert [r.url for r in urls_by_status(known, "failed", "done").collect()] == ["a", "b"]
    assert urls_by_status(known).count() == 0
    assert get_state(known, "c").first().status == "discovered" and get_state(known, "x").count() == 0
    listed = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")
    rows = {r.url: (r.prior_status, r.is_new) for r in select_frontier(listed, known).collect()}
    assert rows == {"a": ("failed", False), "c": ("discovered", False), "d": (None, True)}


def test_refresh(spark):
    listing = spark.createDataFrame([("a", datetime(2024, 5, 2)), ("b", datetime(2024, 1, 1)), ("c", datetime(2024, 1, 1)), ("new", datetime(2024, 5, 2))],
                                    "url string, lastmod timestamp")
    held = spark.createDataFrame([("a", datetime(2024, 5, 1)), ("b", datetime(2024, 5, 1)), ("c", datetime(2024, 2, 1))],
                                 "product_url string, extracted_at timestamp")
    stale = refresh_frontier(listing, held, F.lit("2024-05-10").cast("timestamp"), 30)
    assert {r.url: r.reason for r in stale.collect()} == {"a": "changed", "c": "old"}


def test_batches_are_replayed_and_compacted(spark, tmp_path):
    table = products_table(spark, str(tmp_path / "t"))
    assert isinstance(table, KeyedTable)
    table.write_batch(products(spark, product("A", name="one"), product("B")), 0, "seq")
    table.write_batch(products(spark, product("A", name="two"), product("C")), 1, "seq")
    table.write_batch(products(spark, product("A", name="two"), product("C")), 1, "seq")
    table.write_batch(products(spark).limit(0), 2, "seq")
    expected = {"A": "two", "B": "N B", "C": "N C"}
    assert {r.sku: r.name for r in table.read().collect()} == expected
    small = table.compact(str(tmp_path / "c"))
    assert {r.sku: r.name for r in small.read().collect()} == expected


def test_constraints_are_reported(spark):
    rows = [product("A"), product("A", product_url="other"), product("B", product_url="https://s.example.com/C"), product("C"),
            product("D", availability="Gone", extraction_method="guess")]
    found = {tuple(r) for r in check_constraints(products(spark, *rows)).collect()}
    assert found == {
        ("unique", "sku", "A", 2), ("unique", "product_url", "https://s.example.com/C", 2),
        ("domain", "availability", "Gone", 1), ("domain", "extraction_method", "guess", 1),
    }


def test_exports(spark, tmp_path):
    rows = products(spark, product("B", specifications={"k": 'a"b'}, brand="Ü", extracted_at=datetime(2024, 1, 1, 0, 0, 0, 5000)), product("A"))
    rows.drop("seq").write.parquet(str(tmp_path / "p"))
    stored = read_products(spark, str(tmp_path / "p"))
    for _ in range(2):  # a second export replaces the first
        written = export(stored, str(tmp_path / "out"))
    assert written == {f"{tmp_path}/out/products.{k}": "2 rows" for k in ("csv", "json")}
    lines = [json.loads(x) for f in sorted((tmp_path / "out/products.json").glob("part*")) for x in f.read_text().splitlines()]
    assert [x["sku"] for x in lines] == ["A", "B"] and list(lines[0]) == list(EXPORT_COLUMNS)
    assert lines[0]["brand"] is None and lines[0]["price"] == "1.50" and lines[0]["extracted_at"] == "2024-01-02T03:04:05+00:00"
    assert lines[1]["specifications"] == {"k": 'a"b'} and lines[1]["extracted_at"] == "2024-01-01T00:00:00.005000+00:00"
    files = sorted((tmp_path / "out/products.csv").glob("part*"))
    parsed = [r for f in files for r in csv.DictReader(f.open(newline=""))]
    assert parsed[0]["description"] == 'say "hi",\nthere' and parsed[0]["category_path"] == "A > B" and parsed[0]["item_numbers"] == "1|2"
    assert parsed[0]["brand"] == "" and json.loads(parsed[1]["specifications_json"]) == {"k": 'a"b'}
    with pytest.raises(ValueError):
        export(stored, str(tmp_path / "x"), "xml")


def hot(spark, n=20_000):
    """A third of the rows share one key."""
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 101).alias("k"), "id")


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_ordering_does_not_depend_on_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = hot(spark).repartition(partitions)
        first = {r.k: r.id for r in first_seen(df, "k", "id").collect()}
        last = {r.k: r.id for r in latest_by_key(df, "k", "id").collect()}
        top = first_n(df, "k", "id", 1500, rank_as="r").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"), F.max("r").alias("r"))
        top = {r.k: (r.n, r.m, r.r) for r in top.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ids = {}
    for i in range(20_000):
        ids.setdefault(-1 if i % 3 == 0 else i % 101, []).append(i)
    assert first == {k: v[0] for k, v in ids.items()} and last == {k: v[-1] for k, v in ids.items()}
    assert top == {k: (len(v[:1500]), v[:1500][-1], len(v[:1500])) for k, v in ids.items()}


def test_writers_do_not_replace_each_other(spark, tmp_path):
    table = products_table(spark, f"{tmp_path}/t")
    table.write_batch(products(spark, product("A", name="one"), product("B", name="one")), 0, "seq", "stream-1")
    table.write_batch(products(spark, product("A", name="two")), 0, "seq", "stream-2")
    table.write_batch(products(spark, product("B", name="late")), 1, "seq", "stream-1")
    table.write_batch(products(spark, product("A", name="two")), 0, "seq", "stream-2")
    assert {r.sku: r.name for r in table.read().collect()} == {"A": "two", "B": "late"}
    assert {r.sku: r.name for r in table.compact(f"{tmp_path}/c").read().collect()} == {"A": "two", "B": "late"}


def test_the_last_write_counts_whoever_wrote_it(spark, tmp_path):
    table = products_table(spark, f"{tmp_path}/t")
    a0, b0, a1 = (products(spark, product("A", name=n)) for n in ("a0", "b0", "a1"))
    table.write_batch(a0, 0, "seq", "a")
    table.write_batch(b0, 0, "seq", "b")
    table.write_batch(a1, 1, "seq", "a")
    name = lambda t: [r.name for r in t.read().collect()]
    assert name(table) == ["a1"]
    table.write_batch(b0, 0, "seq", "b")  # a replay keeps its place
    assert name(table) == ["a1"] and table.commit_of(0, "b") == 2 and table.commit_of(7, "c") == 4
    folded = table.compact(f"{tmp_path}/c")
    folded.write_batch(b0, 0, "seq", "b")
    assert name(folded) == ["b0"]
    other = products_table(spark, f"{tmp_path}/t")  # opening it again loses nothing
    assert name(other) == ["a1"]


def test_published_versions_switch_together(spark, tmp_path):
    from catalogspark.schemas import PRODUCT_SCHEMA
    from catalogspark.sources.store import publish, read_published, versions

    path = f"{tmp_path}/p"
    read = lambda **more: {r.sku for r in read_published(spark, path, "products", PRODUCT_SCHEMA, **more).collect()}
    assert read() == set()
    columns = PRODUCT_SCHEMA.fieldNames()
    assert publish(path, products=products(spark, product("A")).select(*columns)) == 1
    merged = read_published(spark, path, "products", PRODUCT_SCHEMA).unionByName(products(spark, product("B")).select(*columns))
    assert publish(path, products=merged) == 2 and read() == {"A", "B"} and read(version=1) == {"A"}
    merged.write.parquet(f"{path}/products/version=3")  # a version whose publisher failed
    assert versions(spark, path) == [1, 2] and read() == {"A", "B"}
    assert publish(path, products=merged.where("sku = 'B'")) == 3 and read() == {"B"}


def test_intermediate_tables_are_removed(spark):
    from pathlib import Path

    from catalogspark import session

    kept = dict(session._made)
    session._made.clear()
    try:
        table = session.materialize(spark.range(5), "numbers")
        (path,) = session._made[spark.sparkContext.applicationId]
        assert table.count() == 5 and Path(path).exists()
        session.close(spark)
        assert not Path(path).exists() and not session._made
    finally:
        session._made.update(kept)


def test_small_and_large_limits_agree(spark):
    from pyspark.sql import functions as F

    from catalogspark.operators.ordering import first_n

    rows = spark.range(300).select((F.col("id") % 4 * F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1000).alias("at"), "id")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r["at"], r["id"])):
        want.setdefault(r["k"], []).append(r["id"])
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "20")
    try:
        for n in (19, 20, 21, 299):
            got = {}
            for r in first_n(rows, "k", ["at", "id"], n, rank_as="rank").orderBy("rank").collect():
                got.setdefault(r["k"], []).append(r["id"])
            assert got == {k: v[:n] for k, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_queries_bound_what_a_task_sorts(spark):
    """A split that rows are picked from is sorted in memory, however wide the rows are made."""
    from __spark_entry__ import queries

    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert queries()["bulk_upsert_count"](spark, "/root/testdata/sf0.001").count() == 1
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"


def test_queries_bound_batches_for_python(spark):
    """A worker holds a batch of texts several times over."""
    from __spark_entry__ import queries

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert queries()["description_cleanup"](spark, "/root/testdata/sf0.001").count() > 0
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
