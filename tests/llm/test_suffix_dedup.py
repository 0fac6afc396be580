"""Removed bytes against every 50-byte string in plain Python, the index family, and edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from catalogspark.llm import suffix_dedup as sd

SF = "/root/testdata/sf0.001"


def brute(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    rank = lambda k: float("inf") if rows[k][0] is None else rows[k][0]
    first = {}
    texts = [(t or "").encode() for _, t in rows]
    for k in order:
        for p in range(len(texts[k]) - 49):
            first.setdefault(texts[k][p : p + 50], rank(k))
    out = []
    for k, (i, _) in enumerate(rows):
        gone = bytearray(len(texts[k]))
        for p in range(len(texts[k]) - 49):
            if first[texts[k][p : p + 50]] < rank(k):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(texts[k], gone) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(gone), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def same(docs, **options):
    key = lambda r: (r[0] is None, r[0] or 0, r[4], r[1])
    got = [(*tuple(r)[:5], bytes(r.kept)) for r in sd.remove_repeats(docs, **options).collect()]
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("block_bytes", [1 << 22, 2000])
def test_table(spark, block_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    same(docs, block_bytes=block_bytes, bucket_bytes=30_000)


def test_planted_passages(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefé \n", k=n))
    passages = [word(n) for n in (48, 49, 50, 51, 60, 75, 200)]
    texts = [None, "", "x" * 49, "x" * 50, "x" * 400, "ab" * 90, "\0" * 70]
    for _ in range(120):
        texts.append("".join(word(rng.randrange(0, 90)) + rng.choice(passages) for _ in range(rng.randrange(4))))
    texts += texts[20:40]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[9]), (None, texts[10]), (None, texts[10]), (50, texts[50])]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, block string")
    same(docs, block_bytes=3000, bucket_bytes=5000)
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def headed(n):
    """Texts that share a header of 40 bytes, with windows across it that are alike in some of them."""
    rng = random.Random(4)
    word = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    tails = [word(60) for _ in range(30)]
    return [word(30) + "This is the header of every hot page. <p>" + (rng.choice(tails) if rng.random() < 0.4 else word(60)) for _ in range(n)]


def test_hot_anchors_do_not_change_the_result(spark):
    texts = headed(300)
    rows = list(enumerate(texts)) + [(5, texts[9]), (None, texts[10]), (None, texts[10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (0, 100, sd.HOT):
        same(docs, block_bytes=3000, bucket_bytes=5000, hot=hot)


def test_hot_anchors_are_spread(monkeypatch):
    """The largest bucket of windows, with documents that all have their own piece of one anchor."""
    monkeypatch.setattr(sd, "HOT", 100)
    texts, buckets = [t.encode() for t in headed(2000)], 8
    blocks = []
    for k in range(0, 2000, 200):
        own = texts[k : k + 200]
        sizes, data = np.array([len(t) for t in own], np.int64), np.frombuffer(b"".join(own), np.uint8)
        blocks.append(sd._row(k, -1, sd._pack(np.arange(k, k + 200), sizes, data)))
    keys = sd._table(list(sd._send_keys(buckets)(blocks)))
    find = sd._find_shared(sd.HOT)
    answers = []
    for b in range(buckets):
        rows = [r for r in keys.to_batches() if r["bucket"][0].as_py() == b]
        if rows:
            answers += find((rows[0]["bucket"][0],), sd._table(rows)).to_batches()
    load = {}
    for own in blocks:
        rows = [own] + [r for r in answers if r["block"][0] == own["block"][0]]
        for r in sd._send_pieces(buckets)((own["block"][0],), sd._table(rows)).to_pylist():
            if r["bucket"] < buckets:
                n = int((sd._unpack(r["data"], "i8", "i4", "u1")[1].astype(np.int64) - 49).sum())
            else:
                n = len(sd._unpack(r["data"], "i8", "u1", "u8")[0])
            load[r["bucket"]] = load.get(r["bucket"], 0) + n
    assert max(load.values()) < sum(load.values()) / 4


def test_levels_find_what_was_inserted():
    rng = np.random.default_rng(0)
    levels, seen = sd.SuffixLevels(), set()
    for _ in range(40):
        batch = np.sort(rng.integers(0, 4000, rng.integers(1, 60)).astype(np.uint64))
        batch = np.unique(batch)
        assert levels.scan(batch, batch).tolist() == [x in seen for x in batch.tolist()]
        new = batch[~levels.scan(batch, batch)]
        levels.insert(new, new)
        seen |= set(batch.tolist())
        sizes = [len(high) for high, _ in levels.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)


def test_batches_do_not_change_the_result():
    rng = np.random.default_rng(1)
    documents, high = rng.integers(0, 30, 500), rng.integers(0, 200, 500).astype(np.uint64)
    want = [any(h == g and e < d for g, e in zip(high, documents)) for h, d in zip(high, documents)]
    for batches in (1, 2, 8, 100):
        assert sd.repeated(documents, high, high, batches).tolist() == want
