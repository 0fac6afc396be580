"""Sharding, quality rules, line deduplication and archives against plain Python, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from math import log

import pytest
import xxhash
from pyspark.sql import functions as F

from catalogspark.llm import line_dedup, quality_rules, sharding, warc
from catalogspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None, None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [None, "", " \n\t", "one", "a b c", "x\n" * 9, "word " * 60, "é ü\x0bß\x0c" * 30, "A\n\nB\nC\n\n\nA\n\nB\nC", "long " * 20_000]


def test_shards_hold_the_rows_law(spark):
    got = QUERIES["op7_sharding"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts)
    slots = defaultdict(list)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sum(r.shard == r.home_shard for r in got) > 0.7 * len(got)


def test_growing_the_ring_moves_little(spark):
    docs = documents(spark, ["t"] * 4000)
    old = {r.doc_id: r.shard for r in sharding.shard_documents(docs).collect()}
    new = {r.doc_id: r.shard for r in sharding.shard_documents(docs, shards=9).collect()}
    assert sum(old[i] != new[i] for i in old) < 0.3 * len(old)


def test_plan_of_loads_places_every_key():
    rng = random.Random(3)
    nodes = sharding.virtual_nodes(4, 5)
    for loads in ([rng.randrange(40) for _ in nodes], [0] * len(nodes), [1000] + [0] * (len(nodes) - 1)):
        total = sum(loads)
        capacity = [total // 4 + (s < total % 4) for s in range(4)]
        pieces = sharding.plan_loads(nodes, loads, capacity)
        assert [sum(e - b for a, b, e, _, _ in pieces if a == arc) for arc in range(len(nodes))] == loads
        assert [sum(e - b for _, b, e, s, _ in pieces if s == shard) for shard in range(4)] == capacity


def test_shards_of_odd_rows(spark):
    docs = documents(spark, EDGES + ["same"] * 50 + ["null"] * 20, [*range(len(EDGES))] + [5] * 50 + [None] * 20)
    got = sharding.shard_documents(docs.withColumn("shard", docs.doc_id).withColumn("arc", docs.text)).collect()
    assert len(got) == len(EDGES) + 70
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_rows_of_one_position_fill_many_ranges(spark):
    docs = documents(spark, ["same"] * 20_000 + ["x", "y"], [None] * 20_000 + [1, 2]).repartition(8)
    got = sharding.shard_documents(docs)
    counts = Counter(r.shard for r in got.select("shard").collect())
    assert sorted(counts.values()) == [2500] * 6 + [2501] * 2
    slots = got.groupBy("shard").agg(F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("n")).collect()
    assert all((r.low, r.high + 1) == (0, r.n) for r in slots)
    placed = docs.select("doc_id", F.lit(3).alias("arc"), F.lit(9).cast("long").alias("place"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r["count"] for r in sharding.in_ranges(placed, ["place", "doc_id"]).groupBy("part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 8 and max(parts) < 2 * 20_002 / 8


def test_ranks_follow_the_ring_order(spark):
    """Ranks of the ranges equal one numbering of the whole arc, in plain Python."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(rng.randrange(1 << 41), i % 7) for i in range(3000)], "k long, tie int")
    got = sharding.place_on_ring(docs, F.col("k"), ["tie", "k"], shards=3, nodes_per_shard=2).collect()
    nodes = sharding.virtual_nodes(3, 2)
    arcs = [[] for _ in nodes]
    for r in got:
        place = r.k % sharding.RING
        arcs[next((i for i, (p, _) in enumerate(nodes) if p >= place), 0)].append((place, r.tie, r.k, r.shard, r.slot))
    pieces = sharding.plan_loads(nodes, [len(a) for a in arcs], [1000] * 3)
    want = {(a, start + i): (shard, base + i) for a, start, end, shard, base in pieces for i in range(end - start)}
    assert all(row[3:] == want[a, rank] for a, rows in enumerate(arcs) for rank, row in enumerate(sorted(rows)))


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    threes = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(threes)
    covered = {i + k for i, x in enumerate(threes) if often[x] > 1 for k in range(3)}
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(w) < 50 or 100 * len(covered) > 50 * len(w),
    )


def test_quality_counts_and_verdicts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op8_quality_rules"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        found = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert found == base_counts(texts[r.doc_id]), r.doc_id
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.Rules().threshold)


def test_quality_of_odd_rows(spark):
    docs = documents(spark, EDGES + ["b c d " * 20, "b c d " * 20], [*range(len(EDGES)), None, None])
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, None), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    scored = quality_rules.score_documents(docs.withColumn("w", docs.text).withColumn("pairs", docs.lang), labels)
    rows = scored.select("_row.doc_id", "_row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(rows) == len(EDGES) + 2
    assert all(tuple(r)[2:] == base_counts(r.text) for r in rows)
    assert quality_rules.score_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_every_trusted_document_counts(spark):
    """More than 50,000 trusted documents, of which each has the word: its target share is exact only if all count."""
    n = 50_400
    docs = spark.range(n + 1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < n, "apple").otherwise("rust").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    rules = quality_rules.Rules()
    expected = n * n / (n + 1000)
    ratio = round(log((n + rules.shrink) / (expected + rules.shrink)), 4)
    rust = round(log(rules.shrink / (1000 * n / (n + 1000) + rules.shrink)), 4)
    assert sorted(x for x in quality_rules.log_ratios(docs, labels, rules) if x) == [rust, ratio]


def test_log_ratio_folds_case(spark):
    """Texts that differ in the case of ASCII letters get equal ratios; repeated windows compare words as written."""
    rng = random.Random(7)
    text = lambda words: " ".join(rng.choices(words, k=80))
    texts = [text(["apple", "pear", "plum", "fig"]) for _ in range(20)] + [text(["rust", "iron", "zinc", "lead"]) for _ in range(20)]
    texts += [texts[0].upper(), texts[0].title(), texts[25].upper(), "one two three ONE TWO THREE"]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    rows = quality_rules.score_documents(documents(spark, texts), labels).collect()
    got = {r["_row"].doc_id: r for r in rows}
    assert got[0].llr > 0.05 > -0.05 > got[25].llr
    assert got[40].llr == got[41].llr == got[0].llr and got[42].llr == got[25].llr
    assert got[40].kept == got[0].kept and got[43].n_repeat_words == 0


def bucket_hashes(text):
    """The hashes of a text's words and pairs of neighbours, by the public library."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    signed = lambda x: x - (x >> 63 << 64)
    w = [signed(xxhash.xxh64(x.encode(), seed=42).intdigest()) for x in WORD.findall(lowered)]
    long = lambda x, seed: xxhash.xxh64(struct.pack("<q", x), seed=seed).intdigest()
    return w + [signed(long(b, long(a, 42))) for a, b in zip(w, w[1:])]


def test_ratio_and_verdict_against_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rules = quality_rules.Rules()
    raw, target, own = Counter(), Counter(), {}
    for i, text in docs:
        own[i] = [h % rules.buckets for h in bucket_hashes(text)]
        raw.update(own[i])
        if i in labels and labels[i].quality == 1 and not labels[i].toxic:
            target.update(own[i])
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: round(log((target[b] + rules.shrink) / (share * raw[b] + rules.shrink)), 4) for b in raw}
    texts = dict(docs)
    for r in QUERIES["op8_quality_rules"](spark, SF).collect():
        n_words, _, _, _, n_repeat, failed = base_counts(texts[r.doc_id])
        llr = sum(ratio[b] for b in own[r.doc_id]) / len(own[r.doc_id]) if own[r.doc_id] else None
        assert (r.llr is None and llr is None) or abs(r.llr - llr) < 1e-9
        assert r.kept == (not failed and llr is not None and llr >= rules.threshold)


def test_repeats_are_counted_as_written(spark):
    texts = ["a b c A B C a b c", "A b C A b C", "a b c d A B C", "x y z x y z X Y Z x y z", "one"]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_rules.score_documents(docs, labels).select("_row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert all(tuple(r)[1:] == base_counts(r.text) for r in rows.collect())


def test_ratios_tell_the_corpora_apart(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choices(["sun", "moon", "star", "sea", "tree", "hill"], k=80)) for _ in range(60)]
    junk = [" ".join(rng.choices(["$$", "||", "buy!!", "win!!", "%%"], k=80)) for _ in range(30)]
    docs = documents(spark, clean + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 40)], "doc_id long, quality int, toxic int")
    rows = quality_rules.score_documents(docs, labels).select("_row.doc_id", "llr").collect()
    assert min(r.llr for r in rows if r.doc_id < 60) > max(r.llr for r in rows if r.doc_id >= 60)


def dedup_plain(texts):
    seen, out = set(), []
    for text in texts:
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone = set()
        for k in range(len(full) - 2):
            window = tuple(lines[i] for i in full[k : k + 3])
            if window in seen:
                gone |= set(full[k : k + 3])
            seen.add(window)
        out.append((None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_lines_against_plain_python(spark):
    rng = random.Random(2)
    texts = EDGES + ["\n".join(rng.choices(["a", "b", "", "c c", " "], k=rng.randrange(30))) for _ in range(150)]
    docs = documents(spark, texts).withColumn("starts", F.lit("mine"))
    got = line_dedup.dedup_lines(docs).orderBy("doc_id").collect()
    assert [(r.text, r.removed_lines) for r in got] == dedup_plain(texts)
    assert "starts" in got[0]


def test_lines_of_equal_rows_and_rows_without_id(spark):
    docs = documents(spark, ["a\nb\nc"] * 4 + ["a\nb\nc\nd"], [1, 1, None, None, 0])
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text, r.removed_lines) for r in line_dedup.dedup_lines(docs).collect()))
    assert got == [(False, 0, "a\nb\nc\nd", 0), (False, 1, "", 3), (False, 1, "", 3), (True, 0, "", 3), (True, 0, "", 3)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.fixture
def pages(spark):
    html = [None, "", "short", "x" * 99, "x" * 100, "é" * 80, "\r\n\r\nWARC/1.1\r\n" * 30, "big" * 300_000]
    rows = [(i, f"http://h/{i % 3}?q=ü \r\n", html[i % len(html)], "extra") for i in range(40)]
    return spark.createDataFrame([*rows, (41, None, "x" * 100, None), (None, "u", "x" * 100, None)], "page_id long, url string, html string, digest string")


def test_archive_round_trip(spark, pages, tmp_path):
    path = f"file://{tmp_path}/archive"
    index = warc.write_bundles(pages, path, frame_bytes=1000, bundle_bytes=200_000)
    html = {r.page_id: (r.html or "") for r in pages.collect()}
    assert index.count() == pages.count() and index.select("bundle").distinct().count() > 1
    first = {}
    for i in sorted(i for i in html if i is not None):
        if len(html[i].encode()) >= 100:
            first.setdefault(html[i], i)
    wanted = spark.createDataFrame([(warc.record_id(i),) for i in (0, 6, 7, 14)], "record_id string")
    fetched = {r.record_id: r for r in warc.fetch_records(spark, path, wanted).collect()}
    assert bytes(fetched[warc.record_id(6)].payload).decode() == html[6] and bytes(fetched[warc.record_id(7)].payload).decode() == html[7]
    assert fetched[warc.record_id(14)].record_type == "revisit" and fetched[warc.record_id(14)].refers_to == warc.record_id(6)
    for r in warc.read_bundles(spark, path).collect():
        if r.record_type == "response" and r.record_id != warc.record_id(None):
            assert bytes(r.payload).decode() == html[int(r.record_id[10:-1])]


def test_archived_pages(spark, pages, tmp_path):
    got = warc.archived_pages(pages, f"file://{tmp_path}/archive").collect()
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert len(got) == len(html)
    for r in got:
        same = [i for i in html if i is not None and html[i] == html[r.page_id]]
        first = min(same) if r.page_id is not None and len(html[r.page_id]) >= 100 else r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(html[r.page_id]), hashlib.sha256(html[r.page_id]).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
    assert warc.archived_pages(pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_pages_that_share_an_id(spark, tmp_path):
    rows = [(1, "a", "x" * 200), (1, "b", "x" * 200), (1, "c", "y" * 150), (2, "d", "x" * 200), (3, "e", "y" * 150), (3, "f", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archived_pages(pages, f"file://{tmp_path}/archive").collect())
    assert got == [(1, 150, "response", None), (1, 200, "response", None), (1, 200, "response", None), (2, 200, "revisit", 1), (3, 1, "response", None), (3, 150, "revisit", 1)]


def test_frames_are_dealt_to_many_tasks(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 600) for i in range(400)], "page_id long, url string, html string").coalesce(1)
    warc.write_bundles(pages, f"file://{tmp_path}/archive", frame_bytes=2000)
    read = warc.read_bundles(spark, f"file://{tmp_path}/archive").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in read) == 400 and len(read) == 8 and max(r["count"] for r in read) < 150
