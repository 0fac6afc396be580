"""Resampling of a corpus towards a target by importance weights over hashed features, with bit-sliced sums.

Features are words and pairs of neighbours, hashed to 10,000 buckets. Each bucket has an integer gain: how much more often the
target has it than the corpus. A document's weight is the mean gain of its features. Its bucket counts are laid out as planes of
10,000 bits, one per binary digit, and so are the positive and the negative gains. The sum over all features is then exact:
for every digit of the counts and every digit of the gains, the bits that both planes share, times a power of two.

A document is drawn if its weight plus a Gumbel number, made from its id, is among the highest.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm import hashing
from catalogspark.session import materialize

#: Documents whose planes are laid out at a time, and the longest word that is hashed side by side with others.
TOGETHER, LONG_WORD = 64, 64

_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_steps() -> np.ndarray:
    """What a byte does to the low byte of a running CRC-32."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


_STEPS = _crc_steps()


def _crc_on(values: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 values carried on over words of `data`, all words a byte at a time; long words one by one."""
    order = np.argsort(-lengths, kind="stable")
    state, at, left = ~values[order], starts[order], lengths[order]
    long = int(np.searchsorted(-left, -LONG_WORD, "left"))
    for i in range(long):
        state[i] = ~np.uint32(zlib.crc32(data[at[i] : at[i] + left[i]].tobytes(), int(~state[i])))
    for k in range(int(left[long]) if long < len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))
        own = state[long:n]
        state[long:n] = _STEPS[(own ^ data[at[long:n] + k]) & np.uint32(255)] ^ (own >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = ~state
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, text number) of the words of each text."""
    inside = ~_GAP[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1 - starts, np.searchsorted(offsets, starts, "right") - 1


def feature_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text number, number of words of each text)."""
    starts, lengths, text = _words(data, offsets)
    data = _LOWER[data]
    single = _crc_on(np.zeros(len(starts), np.uint32), data, starts, lengths)
    after = np.flatnonzero(text[1:] == text[:-1]) + 1
    joined = ~single[after - 1]
    joined = ~(_STEPS[(joined ^ np.uint32(32)) & np.uint32(255)] ^ (joined >> np.uint32(8)))
    double = _crc_on(joined, data, starts[after], lengths[after])
    return np.concatenate([single, double]) % np.uint32(buckets), np.concatenate([text, text[after]]), np.bincount(text, minlength=len(offsets) - 1)


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of the whole table fall into each bucket. A task sends one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in hashing.pieces_of(whole, 0):
                total += np.bincount(feature_buckets(*hashing.texts_of(batch.column(0)), buckets)[0], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in counted.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + n) / ((s + 1) * (T + n)))) for each of the n buckets, in doubles."""
    n, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    gain = lambda s, t: math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n))))
    return np.array([gain(float(s), float(t)) for s, t in zip(corpus, target)], np.int64)


def _plane(on: np.ndarray, rows: int, buckets: int) -> np.ndarray:
    """Rows of bits in 64-bit words; `on` are the positions row * buckets + bucket of those that are set."""
    width = -(-buckets // 64) * 64
    bits = np.zeros((rows, width), bool)
    bits[on // buckets, on % buckets] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, plane) for each digit of the positive and the negative gains."""
    planes = []
    for sign in (1, -1):
        size = np.maximum(sign * gains, 0)
        for digit in range(int(size.max(initial=0)).bit_length()):
            planes.append((sign << digit, _plane(np.flatnonzero(size >> digit & 1), 1, len(gains))[0]))
    return planes


def summed_gains(bucket: np.ndarray, text: np.ndarray, texts: int, planes: list[tuple[int, np.ndarray]], buckets: int) -> np.ndarray:
    """The exact sum of the gains of each text's features."""
    counts = np.bincount(text * buckets + bucket, minlength=texts * buckets)
    there = np.flatnonzero(counts)
    counts = counts[there]
    total = np.zeros(texts, np.int64)
    for digit in range(int(counts.max(initial=0)).bit_length()):
        own = _plane(there[(counts >> digit & 1).astype(bool)], texts, buckets)
        for power, plane in planes:
            total += power * np.bitwise_count(own & plane).sum(axis=1, dtype=np.int64) << digit
    return total


def gumbel(doc_id: int | None, seed: int) -> int:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of the SHA-256 of `seed:doc_id`."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_features, weight, score, n_words) of every row; its memory is bounded by an Arrow batch and the longest text."""
    planes, buckets = gain_planes(gains), len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in hashing.pieces_of(whole, 1):
                bucket, text, n_words = feature_buckets(*hashing.texts_of(batch.column(1)), buckets)
                order = np.argsort(text, kind="stable")
                bucket, text = bucket[order].astype(np.int64), text[order]
                n = np.bincount(text, minlength=len(batch))
                total = np.zeros(len(batch), np.int64)
                for first in range(0, len(batch), TOGETHER):
                    last = min(first + TOGETHER, len(batch))
                    a, b = np.searchsorted(text, [first, last])
                    total[first:last] = summed_gains(bucket[a:b], text[a:b] - first, last - first, planes, buckets)
                weight = total // np.maximum(n, 1)
                score = weight + np.array([gumbel(i, seed) for i in batch.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n), pa.array(weight), pa.array(score), pa.array(n_words)],
                    names=["doc_id", "n_features", "weight", "score", "n_words"],
                )

    return docs.select("doc_id", "text").mapInArrow(weigh, "doc_id long, n_features long, weight long, score long, n_words long")


def resample(
    docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row per row of `docs`; `percent` % of those with `min_words` words have a rank.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Features are words and pairs of neighbours, repeats
    counted, hashed by CRC-32. weight is the floored mean of their gains, score adds the document's Gumbel number. rank counts
    the drawn from 1, by falling score and then by rising doc_id.

    NULL and blank texts have no features and weigh 0. A NULL doc_id is hashed as an empty text and comes last among ties. Rows that
    share a doc_id are judged each by itself, the one with fewer features first among ties; equal ones are interchangeable. Whole texts count, however long. Without a target
    its counts are zero. Further columns are ignored. An empty table gives an empty one.
    """
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = materialize(weighted(docs, gains, seed), "weights")
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = fit.count() * percent // 100
    # numbered within ranges of the order, and moved on by the rows of the ranges before
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")]
    number = F.monotonically_increasing_id()
    sorted_ranges = fit.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    numbered = materialize(sorted_ranges.withColumn("number", number), "ranges")
    part, within = F.shiftright("number", 33), F.col("number").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    starts = docs.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + F.col("within") + 1
    ranked = numbered.withColumns({"part": part, "within": within}).join(starts, "part")
    ranked = ranked.withColumn("rank", F.when(rank <= drawn, rank))
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(rest.select(*out))
