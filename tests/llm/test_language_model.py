"""Scores against counts in plain Python, probabilities that sum to one, and better prediction than smoothed counts."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from math import isclose, log10

import numpy as np
import pytest

from catalogspark.llm import language_model as lm
from catalogspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def expected(rows):
    out = {i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(t for i, text in rows if not out[i] for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    base = lambda t: log10((counts[t] + 0.1) / (n + 0.1 * (v + 1)))
    return [(i, out[i], len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n, sum(map(base, tokens(t)))) for i, t in rows]


def compare(docs, **model):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.score_texts(docs, lm.Model(**model)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(got, key=key), sorted(expected(rows), key=key), strict=True):
        assert tuple(g)[:5] == w[:5] and isclose(g.base_score, w[5], rel_tol=1e-9)
        assert g.score < 0
    return got


@pytest.mark.parametrize("block_bytes", [1 << 24, 3000])
def test_table(spark, block_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = compare(docs, block_bytes=block_bytes, bucket_bytes=100_000)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One one ONE"), (4, "one"), (None, "two"), (10, "a a a"), (5, "x " * 40_000)] + [(7, "same words")] * 5
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, data string")
    compare(docs, block_bytes=50)
    assert lm.score_texts(docs.limit(0)).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm.score_texts(docs.where("doc_id IS NULL")).collect())


def test_neighbours_are_learned(spark):
    rng = random.Random(5)
    after = {"sun": "shines", "rain": "falls", "wind": "blows", "snow": "melts"}
    text = lambda: " ".join(f"{w} {after[w]}" for w in rng.choices(list(after), k=40))
    docs = spark.createDataFrame([(i, text()) for i in range(200)], "doc_id long, text string")
    held = [r for r in lm.score_texts(docs).collect() if r.held_out]
    assert all(r.score > 0.6 * r.base_score for r in held)


def test_histories_do_not_share_restaurants(spark):
    """4,000 histories, each with one successor: with a bounded number of restaurants several successors would share one."""
    n, rng = 4000, random.Random(6)
    pairs = [f"h{k} s{k}" for k in range(n)]
    rows = [(i, " ".join(rng.sample(pairs, 400))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score_texts(docs, lm.Model(block_bytes=200_000, bucket_bytes=50_000)).collect()
    held = [r for r in got if r.held_out]
    # a successor that is certain leaves each pair's first word only, log10(8000) or so, and some for seating
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -2.2


def test_a_word_is_spread_over_buckets():
    """A frequent word's pairs lie in several buckets, and a frequent history's too."""
    grid, hashes = lm._grid(100), np.random.default_rng(2).integers(1, 2**63, 5000).astype(np.uint64)
    one = np.full(5000, 7, np.uint64)
    for buckets in (lm._bucket_of(one, hashes, grid), lm._bucket_of(hashes, one, grid)):
        assert np.bincount(buckets).max() < 5000 / 5


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    words, contexts = 40, 6
    count = rng.poisson(2.0, (words, contexts)) * (rng.random((words, contexts)) < 0.5)
    count[0] = 5
    b = lm._Bucket(np.arange(words) * contexts, np.repeat(np.arange(words), contexts), np.tile(np.arange(contexts), words), count.reshape(-1))
    known = int((count.sum(axis=1) > 0).sum())
    totals = lm.Totals(int(count.sum()), known, count.sum(axis=0).astype(float), np.minimum(count, 1).sum(axis=0).astype(float), 0.5, 0.4, 0.0, 0.0)
    sampler = lm._Sampler(b, totals, lm.Model(), 1)
    for _ in range(3):
        sampler.sweep()
    totals.tables = sampler.tables.reshape(words, contexts).sum(axis=0)
    totals.root_customers, totals.root_tables = float(sampler.tables.sum()), float(sampler.root.sum())
    unseen = (totals.root_discount * totals.root_tables + 10.0) / (known + 1) / (10.0 + totals.root_customers)
    down = (1.0 + totals.discount * totals.tables) / (1.0 + totals.customers) * unseen
    seen = (count.sum(axis=1) > 0).repeat(contexts).reshape(words, contexts)
    total = (sampler.predictive().reshape(words, contexts) * seen).sum(axis=0) + down
    assert np.allclose(total, 1)


def test_seating_has_the_expected_number_of_tables():
    """One at a time against the expectation of the process, computed by dynamic programming."""
    d, rate, n = 0.5, 0.8, 30
    p = {1: 1.0}
    for k in range(1, n):
        q = Counter()
        for t, x in p.items():
            new = rate / (k - d * t + rate)
            q[t + 1] += x * new
            q[t] += x * (1 - new)
        p = q
    mean = sum(t * x for t, x in p.items())
    got = lm._seat(np.random.default_rng(1), np.full(20_000, n), d, np.full(20_000, rate)).mean()
    assert abs(got - mean) < 0.05


def test_query(spark):
    assert QUERIES["op9_pitman_yor_scores"](spark, SF).count() == 200
