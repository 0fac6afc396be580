"""Held-out accuracy, pseudo-labels, and edge cases of the co-trained classifier."""

from __future__ import annotations

import random

import numpy as np
import pytest

from catalogspark.llm import cotraining as ct
from catalogspark.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng, n):
    """Good texts, junk that the layout shows, and toxic texts that only words show."""
    plain = ["".join(rng.choices("aeiourstln", k=rng.randrange(2, 9))) for _ in range(500)]
    rows, truth = [], {}
    for i in range(n):
        kind = rng.choice(["good"] * 6 + ["junk", "toxic"])
        words = rng.choices(plain, k=rng.randrange(40, 200))
        if kind == "junk":
            words = [w.upper() + "!!" for w in words]
        if kind == "toxic":
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(["zounds", "drat", "fie", "knave"])
        text = " ".join(words)
        rows.append((i, text, "en", "bad.example" if kind == "junk" and rng.random() < 0.5 else f"s{i % 9}", len(text)))
        truth[i] = int(kind == "good")
    return rows, truth


def test_accuracy_on_documents_without_label(spark):
    rng = random.Random(9)
    rows, truth = corpus(rng, 2500)
    labels = [(i, int(truth[i] or "zounds" in rows[i][1]), int(any(w in rows[i][1].split() for w in ("zounds", "drat", "fie", "knave")))) for i in range(1900)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in ct.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), ct.Training(per_round=100)).collect()}
    rest = [i for i in truth if i >= 1900]
    good, bad = [i for i in rest if truth[i]], [i for i in rest if not truth[i]]
    assert np.mean([got[i].kept for i in good]) > 0.93 and np.mean([got[i].kept for i in bad]) < 0.25


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.1"])
def test_accuracy_on_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = labels.where("doc_id % 4 <> 0")
    kept = {r.doc_id: r.kept for r in ct.classify(docs, known).collect()}
    held = [(r.doc_id, r.quality == 1 and r.toxic == 0) for r in labels.where("doc_id % 4 = 0").collect()]
    good, bad = [kept[i] for i, g in held if g], [kept[i] for i, g in held if not g]
    assert len(kept) == docs.count() and (np.mean(good) + 1 - np.mean(bad)) / 2 > 0.8


def test_calibration_recovers_a_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < ct._sigmoid(2 * x - 1)).astype(float)
    assert np.allclose(ct._calibrate(x[:, None], y), [2, -1], atol=0.2)


def test_odd_rows(spark):
    rows, truth = corpus(random.Random(1), 60)
    rows += [(100, None, None, None, None), (101, "", "en", "", 0), (None, "words", "en", "s", 5), (3, "again", "en", "s", 5), (3, "again", "en", "s", 5), (102, "long " * 50_000, "", "", 1)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], DOCS + ", words string")
    labels = spark.createDataFrame([(i, truth[i], None) for i in range(50)] + [(3, 0, 1), (None, 1, 0), (4, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = ct.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len(ct.classify(docs.select("doc_id", "text"), labels).collect()) == len(rows)
    assert all(r.kept and r.score is None for r in ct.classify(docs, labels.limit(0)).collect())
    assert ct.classify(docs.limit(0), labels).count() == 0


def test_query_covers_every_document(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op1_cotraining"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
