"""Importance resampling against plain Python, and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from catalogspark.llm import resampling
from catalogspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def brute(rows, target, buckets=10_000, percent=25):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(bucket(f, buckets) for f in features(text)[1])
    for text in target:
        t.update(bucket(f, buckets) for f in features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [floor(1000 * log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out, fit = [], []
    for i, text in rows:
        w, f = features(text)
        weight = sum(gain[bucket(x, buckets)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), None])
        if len(w) >= 20:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_plain_python(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op13_importance_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == brute(docs, target)


@pytest.mark.parametrize("buckets", [10_000, 1, 70])
def test_odd_rows(spark, buckets):
    rng = random.Random(8)
    words = ["The", "the", "é", "naïve", "x-y", "3.14", "日本", "z" * 200, "Z" * 65, "w" * 64, "q" * 63, " ", "{a}"]
    texts = [None, "", " \t", "!!", "a", "A", "é é", "word " * 30_000, "x" * 100_000, *[" ".join(rng.choices(words, k=rng.randrange(80))) for _ in range(60)]]
    ids = [*range(len(texts) - 4), 3, 3, None, None]
    rows = list(zip(ids, texts)) + [(50, "same text of more than twenty words " * 4)] * 5
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, weight int, part string").repartition(3)
    target = spark.createDataFrame([(1, "the naïve"), (2, None), (None, "")], "item_id long, text string")
    assert rows_of(resampling.resample(docs, target, buckets=buckets)) == brute(rows, ["the naïve", None, ""], buckets)
    assert rows_of(resampling.resample(docs, target.limit(0), buckets=buckets, percent=100)) == brute(rows, [], buckets, 100)
    assert resampling.resample(docs.limit(0), target).count() == 0


def test_bit_planes_give_exact_sums():
    rng = np.random.default_rng(1)
    gains = rng.integers(-9000, 9000, 1000)
    gains[:10] = 0
    text = np.sort(rng.integers(0, 7, 50_000))
    bucket = rng.integers(0, 20, 50_000) ** 2
    want = np.bincount(text, weights=gains[bucket], minlength=7).astype(int)
    got = resampling.summed_gains(bucket, text, 7, resampling.gain_planes(gains), 1000)
    assert got.tolist() == want.tolist()
    assert resampling.gain_planes(np.zeros(5, np.int64)) == []
