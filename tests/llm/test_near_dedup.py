"""Near-duplicates against all pairs in plain Python, and edge cases."""

from __future__ import annotations

import random
import re

import pytest

from catalogspark.llm import near_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(lowered)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute(rows):
    """rows: (doc_id, text) with unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def result(docs):
    return {tuple(r) for r in near_dedup.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect()}


def varied(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [1000, 7])
def test_groups_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = [None, "", " \n", "One two", "one  TWO", "a b c d e", "A b\tc d e", "long " * 30_000]
    for _ in range(25):
        base = " ".join(rng.choices(vocabulary, k=rng.randrange(20, 250)))
        texts += [varied(rng, base, rng.randrange(0, 9)) for _ in range(rng.randrange(1, 9))]
    base = " ".join(rng.choices(vocabulary, k=160))
    texts += [varied(rng, base, 3) for _ in range(80)] + [base]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))) for _ in range(60)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 5))
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, node string")
    assert result(docs) == brute(rows)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    same = "one two three four five six"
    docs = spark.createDataFrame([(1, same), (1, same), (1, "other words here"), (2, same), (None, same), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert [x[:3] + (x[3],) for x in got if x[0]] == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert all(x[2] is None and x[3] for x in got if not x[0])
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(rng.choices(["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)], k=120)) for _ in range(3))
    rows = [(5, a), (5, b), (2, b + " more"), (9, a + " more"), (5, ""), (7, c)]
    got = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r[0], r[2], r[3]) for r in got if r[1]} == {(5, 2, False), (2, 2, True), (9, 2, False), (7, 7, True)}
    got = result(spark.createDataFrame([(5, a), (5, b), (2, a)], "doc_id long, text string"))
    assert {(r[0], r[2]) for r in got} == {(5, 2), (2, 2)}
    # one document with many texts, each of which has a near copy of its own
    many = [" ".join(rng.choices(a.split() + b.split() + c.split(), k=90)) for _ in range(40)]
    rows = [(50, t) for t in many] + [(100 + k, t + " end") for k, t in enumerate(many)] + [(50, many[0])]
    assert {r[2] for r in result(spark.createDataFrame(rows, "doc_id long, text string"))} == {50}


def test_rare_misses():
    from math import comb

    p = 0.75
    assert (1 - p**near_dedup.BAND) ** (2 * near_dedup.FUNCTIONS // near_dedup.BAND) < 1e-5
    n = 2 * near_dedup.FUNCTIONS
    assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(near_dedup.LEAST_SHARED)) < 1e-5
