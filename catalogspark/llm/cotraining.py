"""Quality classifier by co-training of a text view and a metadata view.

The text view sees hashed words and word beginnings, the metadata view source, language, length and layout. Both are
logistic regressions. In each round both score all unlabelled documents, and each hands its most confident ones, with the
label it gives them, to the other's training set. In the end the views, calibrated on a fold that no view was trained on,
are combined into one probability for every document.

The driver fits on bounded samples (parameters of `Training`). What grows with the corpus, features and scores, stays in tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm import hashing
from catalogspark.session import materialize

WORD_FEATURES, META_FEATURES = 1 << 16, 1 << 12
_GAPS = np.zeros(256, bool)
_GAPS[:0x30] = _GAPS[0x3A:0x41] = _GAPS[0x5B:0x61] = _GAPS[0x7B:0x80] = True
_SYMBOL = _GAPS.copy()
_SYMBOL[[*range(0x21), 0x2C, 0x2E, 0x27, 0x2D]] = False
FEATURES = "doc_id long, words binary, meta binary"


@dataclass(frozen=True)
class Training:
    """`labelled_rows` bounds the labelled documents that are used, `per_round` those that each view hands over per class and round."""

    labelled_rows: int = 20_000
    rounds: int = 3
    per_round: int = 500
    confidence: float = 0.95
    epochs: int = 30
    seed: int = 7


# --- features -------------------------------------------------------------------------------------


def _word_features(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    hashes, first, starts = hashing.word_hashes(data, offsets, _GAPS)
    number = (hashes % np.uint64(WORD_FEATURES)).astype(np.uint16)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    inside = np.stack([~_GAPS[padded[starts + k]] for k in range(5)]) if len(starts) else np.zeros((5, 0), bool)
    head = sum((padded[starts + k].astype(np.uint64) | np.uint64(32)) << np.uint64(8 * k) for k in range(4)) if len(starts) else hashes
    heads = (hashing.mix(head + hashing.FACTORS[9]) % np.uint64(WORD_FEATURES)).astype(np.uint16)
    longer = inside.all(axis=0)
    return [
        np.unique(np.concatenate([number[a:b], heads[a:b][longer[a:b]]])).tobytes() for a, b in zip(first[:-1], first[1:])
    ]


def _meta_features(row: tuple, data: np.ndarray) -> bytes:
    """Hashed pairs of a property's name and its value or its step on a scale."""
    source, lang, n_chars = row
    n = max(1, len(data))
    lines = int((data == 10).sum()) + 1
    share = lambda mask: int(np.log2(1 + 1000 * mask.sum() / n))
    upper = (data >= 65) & (data <= 90)
    values = (
        source, lang, None if n_chars is None else int(n_chars).bit_length(), lines.bit_length(), (n // lines).bit_length(),
        share(_SYMBOL[data]), share(upper), share((data >= 48) & (data <= 57)), share(data == 32), share(data >= 128),
    )
    return np.unique(np.array([zlib.crc32(f"{k}={v}".encode()) % META_FEATURES for k, v in enumerate(values)], np.uint16)).tobytes()


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in hashing.pieces_of(whole, 1):
            data, offsets = hashing.texts_of(batch.column(1))
            rows = zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))
            meta = [_meta_features(r, data[a:b]) for r, a, b in zip(rows, offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_word_features(data, offsets), pa.binary()), pa.array(meta, pa.binary())], names=["doc_id", "words", "meta"]
            )


# --- views ----------------------------------------------------------------------------------------


def _sparse(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, offsets) of packed rows."""
    sizes = np.array([len(r) // 2 for r in rows], np.int64)
    return np.frombuffer(b"".join(rows), np.uint16).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _logits(weights: np.ndarray, bias: float, rows: list[bytes]) -> np.ndarray:
    """Each row's features share a length of one."""
    index, offsets = _sparse(rows)
    sums = np.concatenate([[0.0], np.cumsum(weights[index])])
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.sqrt(np.maximum(1, np.diff(offsets))) + bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit(rows: list[bytes], labels: np.ndarray, size: int, training: Training) -> tuple[np.ndarray, float]:
    """Logistic regression with balanced classes: adaptive steps over shuffled batches, in an order that the seed fixes."""
    rng = np.random.default_rng(training.seed)
    weights, bias, squares, bias_square = np.zeros(size), 0.0, np.full(size, 1e-3), 1e-3
    balance = np.where(labels == 1, len(labels) / (2 * max(1, labels.sum())), len(labels) / (2 * max(1, (1 - labels).sum())))
    for _ in range(training.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            some = order[at : at + 256]
            picked = [rows[i] for i in some]
            error = (_sigmoid(_logits(weights, bias, picked)) - labels[some]) * balance[some] / len(some)
            index, offsets = _sparse(picked)
            n = np.diff(offsets)
            step = np.bincount(index, np.repeat(error / np.sqrt(np.maximum(1, n)), n), size) + 1e-6 * weights
            squares += step**2
            weights -= 2.0 * step / np.sqrt(squares)
            bias_square += error.sum() ** 2
            bias -= 0.1 * error.sum() / np.sqrt(bias_square)
    return weights, bias


def _calibrate(columns: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Coefficients (one per column, then a constant) of a logistic fit by Newton's method, lightly kept from growing."""
    x = np.column_stack([columns, np.ones(len(columns))])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ beta)
        gradient = x.T @ (p - labels) + 1e-2 * beta
        curvature = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta = beta - np.linalg.solve(curvature, gradient)
    return beta


@dataclass
class Views:
    """Two fitted views, their calibrations, and how they combine. Its size does not depend on the corpus."""

    words: tuple[np.ndarray, float]
    meta: tuple[np.ndarray, float]
    word_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    meta_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    joint: np.ndarray = field(default_factory=lambda: np.array([1.0, 1.0, 0.0]))
    threshold: float = 0.5

    def calibrated(self, words: list[bytes], meta: list[bytes]) -> np.ndarray:
        """Calibrated log odds, a column per view."""
        w, m = _logits(*self.words, words), _logits(*self.meta, meta)
        return np.column_stack([w * self.word_scale[0] + self.word_scale[1], m * self.meta_scale[0] + self.meta_scale[1]])

    def combined(self, odds: np.ndarray) -> np.ndarray:
        return _sigmoid(odds @ self.joint[:2] + self.joint[2])


def _trained(words: tuple[list, np.ndarray], meta: tuple[list, np.ndarray], held: tuple[list, list, np.ndarray], training: Training) -> Views:
    views = Views(_fit(*words, WORD_FEATURES, training), _fit(*meta, META_FEATURES, training))
    if len(set(held[2].tolist())) == 2:
        raw = views.calibrated(held[0], held[1])
        views.word_scale, views.meta_scale = _calibrate(raw[:, :1], held[2]), _calibrate(raw[:, 1:], held[2])
        odds = views.calibrated(held[0], held[1])
        views.joint = _calibrate(odds, held[2])
        views.threshold = _best_threshold(views.combined(odds), held[2])
    return views


def _best_threshold(p: np.ndarray, labels: np.ndarray) -> float:
    """Midway in the gap where the classes' accuracies are greatest together; a lost good document counts one and a half times."""
    order = np.argsort(p)
    bad = np.cumsum(labels[order] == 0) / max(1, (labels == 0).sum())
    good = 1 - np.cumsum(labels[order] == 1) / max(1, (labels == 1).sum())
    at = int(np.argmax(bad + 1.5 * good))
    return float((p[order[at]] + p[order[min(at + 1, len(p) - 1)]]) / 2)


def _score(views: Views):
    shared = views

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = shared.calibrated(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            p = shared.combined(odds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_sigmoid(odds[:, 0])), pa.array(_sigmoid(odds[:, 1])), pa.array(p), pa.array(p >= shared.threshold)],
                names=["doc_id", "text_score", "meta_score", "score", "kept"],
            )

    return run


SCORED = "doc_id long, text_score double, meta_score double, score double, kept boolean"


# --- co-training ----------------------------------------------------------------------------------


def features(docs: DataFrame) -> DataFrame:
    column = lambda name, kind: (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)
    return docs.select("doc_id", "text", column("source", "string"), column("lang", "string"), column("n_chars", "long")).mapInArrow(_featured, FEATURES)


def _labelled(feature_rows: DataFrame, labels: DataFrame, training: Training) -> list:
    """At most `labelled_rows` documents with their label, 1 for quality 1 and no toxicity; of several labels the worst counts."""
    good = F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good")
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(good)
    judged = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.labelled_rows)
    return feature_rows.join(F.broadcast(judged), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").collect()


def train(feature_rows: DataFrame, labels: DataFrame, training: Training = Training()) -> Views | None:
    """The views after all rounds; None if the labels do not have both classes."""
    spark = feature_rows.sparkSession
    rows = _labelled(feature_rows, labels, training)
    held = [r for k, r in enumerate(rows) if k % 5 == 0]
    own = [r for k, r in enumerate(rows) if k % 5]
    if len({r["good"] for r in own}) < 2:
        return None
    sets = {"words": [(bytes(r["words"]), r["good"]) for r in own], "meta": [(bytes(r["meta"]), r["good"]) for r in own]}
    fold = ([bytes(r["words"]) for r in held], [bytes(r["meta"]) for r in held], np.array([r["good"] for r in held], float))
    used = {r["doc_id"] for r in rows}

    def fitted() -> Views:
        part = lambda name: ([x for x, _ in sets[name]], np.array([y for _, y in sets[name]], float))
        return _trained(part("words"), part("meta"), fold, training)

    views = fitted()
    for _ in range(training.rounds):
        # what is used already is at most the labelled sample and what was handed over
        done = spark.createDataFrame([(i,) for i in sorted(used)], "doc_id long")
        pool = feature_rows.where("doc_id IS NOT NULL").join(F.broadcast(done), "doc_id", "left_anti")
        scored = materialize(pool.mapInArrow(_score(views), SCORED).select("doc_id", "text_score", "meta_score"), "cotraining")
        picks = None
        for teacher, learner in (("text_score", "meta"), ("meta_score", "words")):
            for good in (1, 0):
                sure = F.col(teacher) if good else 1 - F.col(teacher)
                best = scored.select("doc_id", sure.alias("sure")).where(F.col("sure") >= training.confidence).dropDuplicates(["doc_id"])
                best = best.orderBy(F.desc("sure"), F.xxhash64("doc_id"), "doc_id").limit(training.per_round)
                best = best.select("doc_id", F.lit(learner).alias("learner"), F.lit(good).alias("good"))
                picks = best if picks is None else picks.unionByName(best)
        found = feature_rows.join(F.broadcast(picks), "doc_id").dropDuplicates(["doc_id", "learner"]).orderBy("doc_id", "learner").collect()
        if not found:
            break
        for r in found:
            sets[r["learner"]].append((bytes(r[r["learner"]]), r["good"]))
            used.add(r["doc_id"])
        views = fitted()
    return views


def classify(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """One row per row of `docs`: doc_id, text_score, meta_score, score (probability of good quality without toxicity) and kept.

    kept: score is at or above the threshold that separates the classes of the held fold best. Documents with a label are scored like
    all others.

    A NULL text has no words, a missing source, language or length is a value of its own, and columns that `docs` lacks count as missing. Rows without doc_id
    are scored, but never trained on. Repeated rows each get their row. Without labels of both classes every score is NULL
    and every document is kept. Further columns are ignored. An empty table gives an empty one.
    """
    feature_rows = materialize(features(docs), "features")
    views = train(feature_rows, labels, training)
    if views is None:
        nothing = [F.lit(None).cast("double").alias(c) for c in ("text_score", "meta_score", "score")]
        return feature_rows.select("doc_id", *nothing, F.lit(True).alias("kept"))
    return feature_rows.mapInArrow(_score(views), SCORED)
