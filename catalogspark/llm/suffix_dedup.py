"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

A string of `LENGTH` bytes counts as repeated if it also starts in a document with a smaller id. Suffixes are sorted by a fingerprint of
their first `LENGTH` bytes, not alphabetically: only equality of that many bytes matters. The steps:

1. Documents are packed into blocks. Every `LENGTH`-byte window has an anchor, the `ANCHOR`-byte string in it with the least hash,
   so equal windows have equal anchors. Each block sends its distinct anchors, spread by range of their hash, and learns
   which of them occur in other documents. Windows with any other anchor cannot be repeated.
2. Neighbouring windows with one anchor make a piece of text. A block sends its distinct pieces, each with the smallest document
   that has it. Their suffixes go through the index family: batches in order of doc_id get a suffix array each, are
   merge-scanned against all levels for windows that smaller documents have, and become a level; levels
   of about equal size merge, so an entry is merged a logarithmic number of times.
3. The answers, a bit per window, return to the blocks, which remove what repeated windows cover.

A frequent passage is sent once per block, so no task receives all its copies. A short string with ever other text around it, as a header
of less than `LENGTH` bytes has, gives one anchor many different pieces. Anchors with more than `HOT` runs send the fingerprints of
their windows instead, each once per block with its smallest document, spread over as many buckets again by fingerprint.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm import hashing
from catalogspark.session import materialize

LENGTH, ANCHOR = 50, 24
SPAN = LENGTH - ANCHOR + 1
#: Anchors are compared by this many bits; equal hashes of different anchors cost time, not correctness.
KEY_BITS = 48
BATCHES = 8
#: Anchors with more runs than this are spread by window.
HOT = 1 << 14
#: Positions hashed at a time, which keeps working memory small.
CHUNK = 1 << 17
NO_ID = np.iinfo(np.int64).max
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
PACKED = "block long, bucket int, data binary"


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<Q", a.nbytes) + a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for t in types:
        n = struct.unpack_from("<Q", raw, at)[0]
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


def _planes(sorted_keys: np.ndarray) -> np.ndarray:
    """Sorted numbers as steps, byte plane by byte plane, which compresses to the bits that they have."""
    steps = np.diff(sorted_keys, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).reshape(-1)


def _from_planes(data: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(data.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each position, as a number."""
    return np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))


def _fingerprints(data: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes at each position; positions too close to the end have none."""
    n = max(0, len(data) - size + 1)
    out = np.zeros(n, np.uint64)
    word = _words_at(data)
    places = [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]
    for start in range(0, n, CHUNK):
        own = out[start : start + CHUNK]
        for k, at in enumerate(places):
            part = word[start + at : start + at + len(own)] * hashing.FACTORS[(k + seed) % 16]
            part ^= part >> np.uint64(29)
            own += part
            own *= hashing.FACTORS[(k + 7 * seed + 3) % 16]
        own[:] = hashing.mix(own)
    return out


def _least_ahead(values: np.ndarray, width: int) -> None:
    """Replace each value by the least of it and the one `width` further on."""
    for start in range(0, len(values) - width, CHUNK):
        end = min(start + CHUNK, len(values) - width)
        values[start:end] = np.minimum(values[start:end], values[start + width : end + width])


class _Block:
    """Documents side by side: bytes, the bounds of each document, and its id."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, data
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @cached_property
    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, first window, one past the last window, document) of each run of windows with one anchor within a document."""
        n, sizes = len(self.data), np.diff(self.offsets)
        if n < LENGTH:
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none, none, none
        least = np.full(n, _LAST, np.uint64)
        least[: n - ANCHOR + 1] = _fingerprints(self.data, ANCHOR, 1)
        width = 1
        while 2 * width <= SPAN:
            _least_ahead(least, width)
            width *= 2
        _least_ahead(least, SPAN - width)
        inside = np.ones(n, bool)
        for start, end in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist()):
            inside[max(start, end - LENGTH + 1) : end] = False
        # a run ends where the anchor changes and with the last window of a document, which the next one is not beside
        change = least[1:] != least[:-1]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | change
        ends = inside
        ends[:-1] &= ~inside[1:] | change
        starts = np.flatnonzero(begins)
        # least hashes lie close to zero, so they are hashed again to spread over the buckets
        return hashing.mix(least[starts]) >> np.uint64(64 - KEY_BITS), starts, np.flatnonzero(ends) + 1, np.searchsorted(self.offsets, starts, "right") - 1

    def keys(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys in order, whether several documents of the block have it, number of runs up to 65535, bounds of each bucket)."""
        key, _, _, doc = self.anchors
        order = np.argsort(key, kind="stable")
        key, ids = key[order], self.ids[doc[order]]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        shared = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(key) else np.zeros(0, bool)
        runs = np.minimum(np.diff(np.append(first, len(key))), 65535).astype(np.uint16)
        key = key[first]
        return key, shared, runs, np.searchsorted(_bucket_of(key, buckets), np.arange(buckets + 1))

    def pieces(self, wanted: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
        """The runs whose anchor is wanted (sorted keys), their text up to the end of the last window, and equal ones numbered.

        Pieces are in order of their keys, those of hot anchors (a flag per wanted key) after all others, from number `cold` on. `of` gives each run the number of its piece; `sample` a run of each piece in its smallest document, `least` that document's id.
        """
        key, start, end, doc = self.anchors
        at = np.searchsorted(wanted, key)
        at[at == len(wanted)] = 0
        hit = (wanted[at] == key) if len(wanted) else np.zeros(len(key), bool)
        late = hot[at[hit]] if len(wanted) else hit[hit]
        key, start, end, ids = key[hit], start[hit], end[hit], self.ids[doc[hit]]
        size = end - start + LENGTH - 1
        a, b = (_run_hash(self.data, start, size, seed) for seed in (2, 5))
        order = np.lexsort((ids, b, a, key, late))
        k, x, y = key[order], a[order], b[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(k) else np.zeros(0, bool)
        of = np.empty(len(k), np.int64)
        of[order] = np.cumsum(new) - 1
        sample = order[new]
        return {"start": start, "end": end, "ids": ids, "of": of, "sample": sample, "key": key[sample], "least": ids[sample], "size": size[sample],
                "cold": int((~late[sample]).sum())}

    def hot_windows(self, pieces: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(high, low, smallest document) of each distinct window of the hot pieces, in order, and the number of each of their windows."""
        cold = pieces["cold"]
        if cold == len(pieces["key"]):
            none = np.zeros(0, np.int64)
            return none.astype(np.uint64), none.astype(np.uint64), none, none
        windows = pieces["size"][cold:] - LENGTH + 1
        at = np.repeat(pieces["start"][pieces["sample"][cold:]] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        high, low = _fingerprints(self.data, LENGTH, 3)[at], _fingerprints(self.data, LENGTH, 4)[at]
        least = np.repeat(pieces["least"][cold:], windows)
        order = np.lexsort((least, low, high))
        h, w = high[order], low[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        return h[new], w[new], least[order][new], of


def _run_hash(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """A hash of data[start:start+size] for runs of different sizes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    window = _fingerprints(data, LENGTH, seed)
    out = hashing.mix(window[start] + np.uint64(seed) * size.astype(np.uint64))
    # the windows at every LENGTH bytes and the last one cover a run
    step, last = start + LENGTH, start + size - LENGTH
    while (more := step < last).any():
        out[more] = hashing.mix(out[more] * hashing.FACTORS[4] + window[step[more]])
        step = step + LENGTH
    return hashing.mix(out * hashing.FACTORS[6] + window[last])


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the key, so that a bucket's sorted keys lie close together."""
    return ((keys >> np.uint64(KEY_BITS - 24)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _row(block: int, bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=["block", "bucket", "data"]
    )


def _table(rows: list[pa.RecordBatch]) -> pa.Table:
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
    return pa.Table.from_batches(rows, schema)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A row per block (bucket -1) with ids, sizes and bytes; a missing id is the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, texts, total = [], [], [], 0

        def emit() -> pa.RecordBatch:
            all_ids, all_sizes, data = np.concatenate(ids), np.concatenate(sizes), np.concatenate(texts)
            digest = hashlib.blake2b(digest_size=8)
            for part in (all_ids, all_sizes, data):
                digest.update(part.tobytes())
            return _row(int.from_bytes(digest.digest(), "little") >> 1, -1, _pack(all_ids, all_sizes, data))

        for whole in batches:
            for batch in hashing.pieces_of(whole, 1, block_bytes // 4):
                data, offsets = hashing.texts_of(batch.column(1))
                ids.append(batch.column(0).fill_null(NO_ID).to_numpy())
                sizes.append(np.diff(offsets))
                texts.append(data)
                total += len(data)
                if total >= block_bytes:
                    yield emit()
                    ids, sizes, texts, total = [], [], [], 0
        if ids:
            yield emit()

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def _opened(data: bytes) -> _Block:
    return _Block(*_unpack(data, "i8", "i8", "u1"))


def _send_keys(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                key, shared, runs, cuts = _opened(data.as_py()).keys(buckets)
                for b in np.flatnonzero(np.diff(cuts)):
                    own = slice(cuts[b], cuts[b + 1])
                    yield _row(name, int(b), _pack(_planes(key[own]), np.packbits(shared[own]), runs[own]))

    return run


def _find_shared(hot: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """For each block, two bits per key that it sent: whether several documents have it, and whether it has more than `hot` runs."""
        # equal blocks send the same and may share their answer
        rows, keys, shared, runs = dict(zip(table["block"].to_pylist(), table["data"].to_pylist())), [], [], []
        for data in rows.values():
            planes, bits, n = _unpack(data, "u1", "u1", "u2")
            keys.append(_from_planes(planes))
            shared.append(np.unpackbits(bits, count=len(keys[-1])).astype(bool))
            runs.append(n)
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(first, len(ordered)))
        found = (counts > 1) | np.logical_or.reduceat(np.concatenate(shared)[order], first)
        many = np.add.reduceat(np.concatenate(runs)[order].astype(np.int64), first) > hot
        bits = np.empty((2, len(every)), bool)
        bits[:, order] = np.repeat([found, many], counts, axis=1)
        cuts = np.cumsum([0, *map(len, keys)])
        return _table([_row(b, key[0].as_py(), _pack(*(np.packbits(x[i:j]) for x in bits))) for b, i, j in zip(rows, cuts[:-1], cuts[1:])])

    return run


def _wanted(block: _Block, buckets: int, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The block's keys that other documents have, in order, and whether they are hot."""
    key, _, _, cuts = block.keys(buckets)
    wanted, hot = np.zeros(len(key), bool), np.zeros(len(key), bool)
    for b, data in answers.items():
        for out, bits in zip((wanted, hot), _unpack(data, "u1", "u1")):
            out[cuts[b] : cuts[b + 1]] = np.unpackbits(bits, count=cuts[b + 1] - cuts[b]).astype(bool)
    return key[wanted], hot[wanted]


def _in_buckets(pieces: dict[str, np.ndarray], buckets: int) -> np.ndarray:
    """Each bucket's bounds among the pieces that are not hot, which are in order of their keys."""
    return np.searchsorted(_bucket_of(pieces["key"][: pieces["cold"]], buckets), np.arange(buckets + 1))


def _in_hot_buckets(high: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds among sorted fingerprints of each bucket for hot windows, which are numbered from `buckets` on."""
    return np.searchsorted(_bucket_of(high >> np.uint64(64 - KEY_BITS), buckets), np.arange(buckets + 1))


def _send_pieces(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = dict(zip(table["bucket"].to_pylist(), table["data"].to_pylist()))
        block = _opened(rows.pop(-1))
        pieces = block.pieces(*_wanted(block, buckets, rows))
        cuts = _in_buckets(pieces, buckets)
        out = []
        for b in np.flatnonzero(np.diff(cuts)):
            own = pieces["sample"][cuts[b] : cuts[b + 1]]
            size = pieces["size"][cuts[b] : cuts[b + 1]]
            spread = np.repeat(pieces["start"][own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out.append(_row(key[0].as_py(), int(b), _pack(pieces["least"][cuts[b] : cuts[b + 1]], size.astype(np.int32), block.data[spread])))
        high, low, least, _ = block.hot_windows(pieces)
        cuts = _in_hot_buckets(high, buckets)
        for b in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[b], cuts[b + 1])
            out.append(_row(key[0].as_py(), int(buckets + b), _pack(least[own], _planes(high[own]), low[own])))
        return _table(out)

    return run


class SuffixLevels:
    """A logarithmic family of suffix arrays: sorted fingerprints, each level at least twice the size of the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether each suffix of a sorted batch is in some level."""
        found = np.zeros(len(high), bool)
        for level_high, level_low in self.levels:
            at = np.minimum(np.searchsorted(level_high, high), len(level_high) - 1)
            found |= (level_high[at] == high) & (level_low[at] == low)
        return found

    def insert(self, high: np.ndarray, low: np.ndarray) -> None:
        """Add a sorted batch as a level, merging it with levels until the next is more than twice as large."""
        if not len(high):
            return
        while self.levels and len(self.levels[-1][0]) < 2 * len(high):
            other_high, other_low = self.levels.pop()
            high, low = np.concatenate([other_high, high]), np.concatenate([other_low, low])
            order = np.argsort(high, kind="stable")
            high, low = high[order], low[order]
        self.levels.append((high, low))


def repeated(documents: np.ndarray, high: np.ndarray, low: np.ndarray, batches: int = BATCHES) -> np.ndarray:
    """Whether each suffix, given by its document and fingerprint, occurs in a smaller document."""
    out, levels = np.zeros(len(documents), bool), SuffixLevels()
    by_document = np.argsort(documents, kind="stable")
    ordered = documents[by_document]
    cuts = np.unique(np.searchsorted(ordered, ordered[np.linspace(0, len(ordered) - 1, batches + 1).astype(np.int64)])) if len(ordered) else []
    for start, end in zip(cuts, [*cuts[1:], len(ordered)]):
        batch = by_document[start:end]
        batch = batch[np.argsort(high[batch], kind="stable")]
        h, w, d = high[batch], low[batch], documents[batch]
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
        starts = np.flatnonzero(first)
        smallest = np.repeat(d[starts], np.diff(np.append(starts, len(d))))
        known = levels.scan(h, w)
        out[batch] = known | (smallest < d)
        levels.insert(h[first & ~known], w[first & ~known])
    return out


def _match_hot(key: tuple, table: pa.Table) -> pa.Table:
    """For each block, a bit per window that it sent. A window comes once per block, so no fingerprint gathers here."""
    blocks, least, high, low = table["block"].to_pylist(), [], [], []
    for data in table["data"].to_pylist():
        d, h, w = _unpack(data, "i8", "u1", "u8")
        least.append(d)
        high.append(_from_planes(h))
        low.append(w)
    bits = repeated(np.concatenate(least), np.concatenate(high), np.concatenate(low))
    cuts = np.cumsum([0, *map(len, least)])
    return _table([_row(b, key[0].as_py(), _pack(np.packbits(bits[i:j]))) for b, i, j in zip(blocks, cuts[:-1], cuts[1:])])


def _match_any(buckets: int):
    return lambda key, table: (_match if key[0].as_py() < buckets else _match_hot)(key, table)


def _match(key: tuple, table: pa.Table) -> pa.Table:
    """For each block, a bit per window of each piece that it sent."""
    blocks, least, sizes, texts = table["block"].to_pylist(), [], [], []
    for data in table["data"].to_pylist():
        d, n, t = _unpack(data, "i8", "i4", "u1")
        least.append(d)
        sizes.append(n)
        texts.append(t)
    size, text = np.concatenate(sizes).astype(np.int64), np.concatenate(texts)
    windows = size - LENGTH + 1
    starts = (np.cumsum(size) - size)
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    high, low = _fingerprints(text, LENGTH, 3)[at], _fingerprints(text, LENGTH, 4)[at]
    bits = repeated(np.repeat(np.concatenate(least), windows), high, low)
    cuts = np.concatenate([[0], np.cumsum([int((n - LENGTH + 1).sum()) for n in sizes])])
    return _table([_row(b, key[0].as_py(), _pack(np.packbits(bits[i:j]))) for b, i, j in zip(blocks, cuts[:-1], cuts[1:])])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(buckets: int, with_bytes: bool):
    def run(table: pa.Table) -> pa.Table:
        own, shared, answers = None, {}, {}
        for b, step, data in zip(table["bucket"].to_pylist(), table["step"].to_pylist(), table["data"].to_pylist()):
            if b < 0:
                own = (data, 1 if own is None else own[1] + 1)
            else:
                (shared if step == 1 else answers)[b] = data
        block = _opened(own[0])
        pieces = block.pieces(*_wanted(block, buckets, shared))
        cuts = _in_buckets(pieces, buckets)
        windows = pieces["size"] - LENGTH + 1
        first = np.concatenate([[0], np.cumsum(windows)])
        hit = np.zeros(first[-1], bool)
        high, _, hot_least, of_hot = block.hot_windows(pieces)
        hot_hit, hot_cuts = np.zeros(len(high), bool), _in_hot_buckets(high, buckets)
        for b, data in answers.items():
            (bits,) = _unpack(data, "u1")
            if b < buckets:
                i, j = first[cuts[b]], first[cuts[b + 1]]
                hit[i:j] = np.unpackbits(bits, count=j - i).astype(bool)
            else:
                i, j = hot_cuts[b - buckets], hot_cuts[b - buckets + 1]
                hot_hit[i:j] = np.unpackbits(bits, count=j - i).astype(bool)
        # the smallest document of the block that has a window: for a hot piece of any piece with it, else of the piece
        least = np.repeat(pieces["least"], windows)
        if len(of_hot):
            at_hot = first[pieces["cold"]]
            hit[at_hot:], least[at_hot:] = hot_hit[of_hot], hot_least[of_hot]
        # windows of a run: those of its piece, or those that a smaller document of the block has
        n = pieces["end"] - pieces["start"]
        shift = np.arange(n.sum()) - np.repeat((np.cumsum(n) - n), n)
        window = np.repeat(first[pieces["of"]], n) + shift
        gone = hit[window] | (np.repeat(pieces["ids"], n) > least[window])
        at = (np.repeat(pieces["start"], n) + shift)[gone]
        change = np.zeros(len(block.data) + LENGTH + 1, np.int32)
        change[at] += 1
        change[at + LENGTH] -= 1
        covered = np.cumsum(change[: len(block.data)]) > 0
        rows = []
        for doc, i, j in zip(block.ids.tolist(), block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
            mask = covered[i:j]
            removed = int(mask.sum())
            kept = (block.data[i:j][~mask] if removed else block.data[i:j]).tobytes()
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0
            digest = hashlib.sha256(kept).hexdigest()
            rows.append((None if doc == NO_ID else doc, j - i, removed, spans, digest, kept if with_bytes else None))
        names = [c.split()[0] for c in RESULT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table({c: pa.array(list(x), t) for c, t, x in zip(names, types, zip(*(rows * own[1])))})

    return run


def remove_repeats(docs: DataFrame, *, with_bytes: bool = True, block_bytes: int = 1 << 22, bucket_bytes: int = 1 << 23, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    Removed is each byte that a 50-byte string covers which also starts in a document with a smaller doc_id, judged on the input. A NULL
    text is empty; texts of fewer than 50 bytes stay. Rows without doc_id come after all others and remove nothing from each
    other, and neither do rows with equal ids. Whole texts are used. Further columns are ignored. An
    empty table gives an empty one. Kept bytes need not be valid UTF-8.
    """
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(8, -(-size // bucket_bytes))
    blocks = materialize(_blocks(docs, block_bytes), "suffix-blocks")
    keys = blocks.mapInArrow(_send_keys(buckets), PACKED)
    shared = materialize(keys.groupBy("bucket").applyInArrow(_find_shared(hot), PACKED), "suffix-shared")
    sent = blocks.unionByName(shared).groupBy("block").applyInArrow(_send_pieces(buckets), PACKED)
    answers = sent.groupBy("bucket").applyInArrow(_match_any(buckets), PACKED)
    steps = blocks.withColumn("step", F.lit(0)).unionByName(shared.withColumn("step", F.lit(1)))
    steps = steps.unionByName(answers.withColumn("step", F.lit(2)))
    out = steps.groupBy("block").applyInArrow(_remove(buckets, with_bytes), RESULT)
    return out if with_bytes else out.drop("kept")
