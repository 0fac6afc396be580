"""Words of an Arrow batch of texts as 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random odd number for each byte; white space counts nothing.
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODE[_IS_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _BASE, np.uint64))
#: Odd factors for the words of a shingle, the first of them for the word in front.
FACTORS = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a NULL is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text, at least a row each, which bounds working memory."""
    _, offsets = texts_of(batch.column(column))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first word of each text and their number, starting bytes): words are runs of bytes that are no gaps, A-Z lower-cased."""
    global _POWERS
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    data = _LOWER[data]
    word = ~gaps[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = word[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), starts
    place = np.arange(len(data), dtype=np.int64)
    place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    code = np.where(gaps, np.uint64(0), _CODE)[data]
    if (longest := int(place[word].max()) + 1) > len(_POWERS):
        _POWERS = np.cumprod(np.full(longest, _BASE, np.uint64))
    code *= _POWERS[np.minimum(place, len(_POWERS) - 1)]
    return mix(np.add.reduceat(code, starts)), np.searchsorted(starts, offsets), starts


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the shingles of `size` words of each text in order; a shorter text is one shingle, an empty one none."""
    counts = np.diff(first)
    per_text = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    out = np.empty(offsets[-1], np.uint64)
    n = len(words) - size + 1
    if n > 0:
        rolled = words[:n] * FACTORS[0]
        for k in range(1, size):
            rolled += words[k : n + k] * FACTORS[k]
        inside = np.repeat(counts >= size, per_text)
        at = np.repeat(first[:-1] - offsets[:-1], per_text) + np.arange(offsets[-1])
        out[inside] = mix(rolled[at[inside]])
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[first[i] : first[i + 1]]
        out[offsets[i]] = mix(np.array([(own * FACTORS[8 : 8 + len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]
    return out, offsets


def sorted_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) with the distinct values of each text in order."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
