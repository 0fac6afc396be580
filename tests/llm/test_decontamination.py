"""Leaks against every window in plain Python, the index against every pair, and edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter


from catalogspark.llm import decontamination as dc
from catalogspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)])


def brute(docs, items):
    found, worded = set(), [(doc, tokens(text)) for doc, text in docs]
    fives = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, w in worded]
    for item, text in items:
        want = tokens(text)
        if not want or item is None:
            continue
        b = bag(want)
        for (doc, w), own in zip(worded, fives):
            # without a common shingle the similarity is 0
            if not w or (not own & set(b) if min(len(w), len(want)) >= 5 else not set(w) & set(want)):
                continue
            for s in range(max(1, len(w) - len(want) + 1)):
                a = bag(w[s : s + len(want)])
                both = sum((a & b).values())
                if 100 * both >= 75 * (sum(a.values()) + sum(b.values()) - both):
                    found.add((doc, item))
                    break
    return found


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_table(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = pairs(QUERIES["op3_simhash_decontamination"](spark, SF))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got


def test_planted_items(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    some = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, " ".join(some(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 9, 20, 35, 60, 60])]
    items += [(50, "echo " * 30), (51, None), (52, " \n"), (None, "no id here at all"), (53, items[8][1])]
    docs = [(0, None), (1, ""), (2, "\t"), (3, "echo " * 500), (4, items[9][1].upper())]
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            part = (rng.choice(items)[1] or "").split()
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(part) + 1)
                part[at : at + rng.randrange(2)] = some(rng.randrange(2))
            words += some(rng.randrange(40)) + part
        docs.append((len(docs), " \n".join(words)))
    docs += [(7, docs[20][1]), (None, docs[30][1])]
    frame = spark.createDataFrame([(i, t, "mine") for i, t in docs], "doc_id long, text string, start string")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, size string")
    want = brute(docs, items)
    assert pairs(dc.leaks(frame, bench)) == want
    clean = [r for r in docs if not any(x == (r[0]) for x, _ in want)]
    assert len(dc.without_leaks(frame, bench).collect()) == len([1 for i, t in docs if not brute([(i, t)], items)]) >= len(clean)
    assert dc.leaks(frame.limit(0), bench).count() == 0 and dc.leaks(frame, bench.limit(0)).count() == 0
    assert dc.without_leaks(frame, bench.limit(0)).count() == len(docs)


def test_index_finds_every_pair_within_the_radius(spark):
    rng = random.Random(7)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(64) for _ in range(8)]
    flip = lambda x: x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(30)))
    windows = [(i, 5, signed(flip(rng.choice(base)))) for i in range(300)]
    items = [(i, 5 if i else 6, signed(x)) for i, x in enumerate(base)]
    got = dc.within_radius(spark.createDataFrame(windows, "w long, size int, bits long"), spark.createDataFrame(items, "item long, size int, item_bits long"), 23)
    want = sorted((w, i) for w, s, x in windows for i, z, y in items if s == z and bin((x ^ y) & (1 << 64) - 1).count("1") <= 23)
    assert sorted((r.w, r.item) for r in got.collect()) == want


def test_index_meets_only_the_item_of_a_window(spark):
    """Items of one size and like fingerprints: a window meets those that it was laid for, whatever their number."""
    rng = random.Random(8)
    base = rng.getrandbits(62)
    items = [(i, 60, base ^ (1 << i % 60)) for i in range(500)]
    windows = [(i, i % 500, 60, base) for i in range(2000)]
    left = spark.createDataFrame(windows, "w long, item long, size int, bits long")
    right = spark.createDataFrame(items, "item long, size int, item_bits long")
    got = dc.within_radius(left, right, 23, ("size", "item")).collect()
    assert sorted((r.w, r.item) for r in got) == [(w, i) for w, i, _, _ in windows]


def test_items_of_equal_text_and_of_shared_passages(spark):
    rng = random.Random(10)
    some = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    passage = some(30)
    items = [(i, " ".join(passage + some(i % 6))) for i in range(40)] + [(100 + i, " ".join(passage)) for i in range(5)]
    docs = [(i, " ".join(some(i) + passage + some(9))) for i in range(30)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_a string")
    got = pairs(dc.leaks(frame, spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, items) and len(got) == len(docs) * sum(i >= 100 or i % 6 < 5 for i, _ in items)


def test_fingerprint_counts_every_occurrence(spark):
    rows = [([1, 1, 2],), ([2, 2, 1],), ([-1],), ([7],)]
    got = [r[0] for r in spark.createDataFrame(rows, "h array<long>").select(dc.fingerprint("h")).collect()]
    assert got == [1, 2, -1, 7]


def qualifying(docs, items):
    """How many windows of a document are as similar to an item as is asked for, of any order."""
    found = {}
    for doc, text in docs:
        for item, own in items:
            w, want = tokens(text), tokens(own)
            b, n = bag(want), 0
            for s in range(max(1, len(w) - len(want) + 1)):
                a = bag(w[s : s + len(want)])
                both = sum((a & b).values())
                n += 100 * both >= 75 * (sum(a.values()) + sum(b.values()) - both)
            if n:
                found[doc, item] = n
    return found


def test_every_window_of_a_text_is_fingerprinted(spark):
    rng = random.Random(11)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    texts = [(i, [rng.getrandbits(64) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 8, 9, 10, 40])]
    texts.append((8, [texts[7][1][i % 3] for i in range(30)]))
    frame = spark.createDataFrame([(i, [signed(x) for x in h]) for i, h in texts] + [(9, None)], "i int, grams array<long>")
    got = sorted(tuple(r) for r in dc.every_window(frame, ["i"], [1, 2, 3, 4, 5, 9]).collect())
    votes = lambda h: signed(sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)))
    assert got == sorted((i, p, w, votes(h[p : p + w])) for i, h in texts for w in (1, 2, 3, 4, 5, 9) for p in range(len(h) - w + 1))


def test_index_of_pieces_finds_every_pair_within_three_bits(spark):
    rng = random.Random(12)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rng.getrandbits(64) for _ in range(8)]
    flip = lambda x: x ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))
    windows = [(i, 9, signed(flip(rng.choice(base)))) for i in range(300)]
    pieces = [(i, 9 if i else 5, signed(x)) for i, x in enumerate(base)]
    left, right = spark.createDataFrame(windows, "w long, width int, bits long"), spark.createDataFrame(pieces, "piece long, width int, item_bits long")
    got = dc.within_radius(left, right, 3, ("width",), dc.PIECE_BLOCKS)
    want = sorted((w, i) for w, s, x in windows for i, z, y in pieces if s == z and bin((x ^ y) & (1 << 64) - 1).count("1") <= 3)
    assert sorted((r.w, r.piece) for r in got.collect()) == want and want


def test_parts_of_an_item_in_another_order(spark):
    rng = random.Random(13)
    some = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    items = [(i, some(60)) for i in range(4)] + [(9, some(30))]
    a = [w for _, w in items]
    docs = [a[0][30:] + a[0][:30], a[1][48:] + a[1][12:48] + a[1][:12], a[2][40:] + a[2][20:40] + a[2][:20], a[3] * 4, a[4][14:] + a[4][:14]]
    docs = [(i, " ".join(some(25) + w + some(25))) for i, w in enumerate(docs)]
    items = [(i, " ".join(w)) for i, w in items]
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = qualifying(docs, items)
    assert {(r.doc_id, r.item_id): r.n_windows for r in got} == want and len(want) >= 4


def test_items_that_repeat_their_own_phrases(spark):
    rng = random.Random(14)
    some = lambda n, k: [rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n)]
    items = [(i, some(n, k)) for i, (n, k) in enumerate([(n, k) for n in (5, 7, 11, 15, 16, 25, 40, 60) for k in (2, 4, 9, 26)])]
    docs = []
    for _ in range(60):
        part = list(rng.choice(items)[1])
        for _ in range(rng.randrange(4)):
            x, y = sorted(rng.randrange(len(part) + 1) for _ in range(2))
            # a word changed, added or lost, or two parts swapped
            part = rng.choice([part[:x] + some(1, 26) + part[x + 1 :], part[:x] + some(1, 26) + part[x:], part[:x] + part[x + 1 :], part[y:] + part[x:y] + part[:x]])
        docs.append((len(docs), " ".join(some(rng.randrange(9), 26) + part + some(rng.randrange(9), 26))))
    items = [(i, " ".join(w)) for i, w in items]
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = qualifying(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == set(want) and len(want) > 30
