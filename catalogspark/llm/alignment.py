"""Alignment of the tokens that two tokenizers make of the same texts.

Each tokenizer's cumulative byte ends are the keys of a dictionary from end to token index. The sorted keys that both dictionaries have
slice the two lists of ids into groups that cover the same bytes. Within a slice, each pair of tokens whose bytes overlap is a link.

How often two ids are linked is counted over the whole corpus. Texts are encoded once, in chunks of bounded size. A chunk keeps
its links as places in its own list of distinct id pairs; only those lists, with their counts, are shuffled, and each chunk
gets the corpus-wide counts of its pairs back.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm import hashing
from catalogspark.session import materialize

#: Bytes of text in a chunk, and of those that are encoded at a time; a longer text is a chunk by itself.
CHUNK, PART = 1 << 22, 1 << 18
#: Digits of the largest id that is written out, and the place of the first id in a pair's number.
DIGITS, SHIFT = 7, 32
# Fixed value: how the byte-level vocabulary splits texts before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BEYOND_LATIN = re.compile("[^\x00-\u024f\u2010-\u2027]")

ENCODED = (
    "chunk long, pairs array<long>, times array<long>, doc_ids array<long>, n_a array<long>, n_b array<long>, "
    "n_groups array<long>, n_links array<long>, groups_sha256 array<string>, links binary"
)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _numbers(values: list[int]) -> np.ndarray:
    return np.frombuffer(array("q", values), np.int64)


class Vocabulary:
    """The bytes of each id: as a list, and end to end with their places."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.length = tokens, np.array([len(t) for t in tokens])
        self.start, self.joined = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(tokens), np.uint8)

    def gives(self, ids: list[np.ndarray], texts: list[bytes]) -> np.ndarray:
        """Whether the ids of each text, written out, are the text."""
        flat, n = np.concatenate(ids), np.array([len(i) for i in ids])
        size, ends = self.length[flat], np.cumsum([len(t) for t in texts])
        if n.all() and np.array_equal(np.cumsum(size)[np.cumsum(n) - 1], ends):
            at = np.repeat(self.start[flat] - (np.cumsum(size) - size), size) + np.arange(ends[-1])
            if np.array_equal(self.joined[at], np.frombuffer(b"".join(texts), np.uint8)):
                return np.ones(len(ids), bool)
        return np.array([b"".join([self.tokens[k] for k in i]) == t for i, t in zip(ids, texts)])


class ByteTokenizer:
    """A byte-level vocabulary: ids of space + text, and the bytes of each id.

    If the file's merges stand in the order of their ids, Latin texts are encoded by the faster of the two public libraries, which takes
    such a vocabulary as ranks. All other texts go to the library of the file itself.
    """

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.encode_special_tokens = True
        model, to_byte = json.loads(source)["model"], _byte_of()
        special = {t["content"] for t in json.loads(source).get("added_tokens", [])}
        names = {i: name for name, i in model["vocab"].items()}
        top = max([*names, *self.library.get_vocab().values()]) + 1
        encoded = lambda name: name.encode() if name in special else bytes(to_byte[c] for c in name)
        tokens = [encoded(names[i]) if i in names else b"" for i in range(top)]
        self.vocabulary = Vocabulary(tokens)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = None
        if [model["vocab"].get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))):
            import tiktoken

            ranks = {b: i for i, b in enumerate(tokens) if names.get(i) not in special and b}
            self.ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        own = [i for i, t in enumerate(texts) if self.ranks is None or _BEYOND_LATIN.search(t)]
        found = self.library.encode_batch([" " + texts[i] for i in own], add_special_tokens=False)
        out = {i: e.ids for i, e in zip(own, found)}
        return [_numbers(out[i] if i in out else self.ranks.encode_ordinary(" " + t)) for i, t in enumerate(texts)]


class PieceTokenizer:
    """A sentence-piece vocabulary, which puts the space in front itself: ids of a text, and the bytes of each id."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        written = lambda i, n: bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace("▁", " ").encode()
        self.vocabulary = Vocabulary([written(i, n) for i, n in enumerate(names)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [_numbers(ids) for ids in self.library.encode(texts, num_threads=1)]


def common_cuts(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """How many tokens of either list lie before each byte offset at which both have a token's end."""
    at_a = dict(zip(a_ends, range(1, len(a_ends) + 1)))
    at_b = dict(zip(b_ends, range(1, len(b_ends) + 1)))
    common = sorted(at_a.keys() & at_b.keys())
    return list(map(at_a.__getitem__, common)), list(map(at_b.__getitem__, common))


def _digits(top: int) -> np.ndarray:
    """The decimal digits of each id, zero bytes behind them."""
    return np.array([str(i) for i in range(top)], f"S{DIGITS}").view(np.uint8).reshape(top, DIGITS)


class Aligner:
    """Two tokenizers over the same texts."""

    def __init__(self, byte_source: str, piece_proto: bytes):
        self.a, self.b = ByteTokenizer(byte_source), PieceTokenizer(piece_proto)
        self.a_length, self.b_length = self.a.vocabulary.length, self.b.vocabulary.length
        self.a_digits, self.b_digits = _digits(len(self.a_length)), _digits(len(self.b_length))

    def part(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(tokens of A, tokens of B and groups of each text, digests of the groups, the id pair of each link in order)."""
        given = [i for i, t in enumerate(texts) if t]
        if not given:
            return np.zeros((3, len(texts)), np.int64), [""] * len(texts), np.zeros(0, np.int64)
        all_a, all_b = self.a.encode([texts[i] for i in given]), self.b.encode([texts[i] for i in given])
        written = [b" " + texts[i].encode() for i in given]
        same = self.a.vocabulary.gives(all_a, written) & self.b.vocabulary.gives(all_b, written)
        sizes = np.zeros((3, len(texts)), np.int64)
        a_ids, b_ids, a_cuts, b_cuts, a_before, b_before = [], [], [], [], 0, 0
        for i, a, b, ok in zip(given, all_a, all_b, same):
            if not ok:
                continue
            in_a, in_b = common_cuts(np.cumsum(self.a_length[a]).tolist(), np.cumsum(self.b_length[b]).tolist())
            a_cuts.append(_numbers(in_a) + a_before)
            b_cuts.append(_numbers(in_b) + b_before)
            sizes[:, i] = len(a), len(b), len(in_a)
            a_ids.append(a)
            b_ids.append(b)
            a_before, b_before = a_before + len(a), b_before + len(b)
        if not a_ids:
            return sizes, [""] * len(texts), np.zeros(0, np.int64)
        a, b = np.concatenate(a_ids), np.concatenate(b_ids)
        digests = self._digests(a, b, np.concatenate(a_cuts), np.concatenate(b_cuts), sizes[0] + sizes[1])
        return sizes, digests, self._links(a, b)

    def _digests(self, a_ids, b_ids, a_end, b_end, n_tokens) -> list[str]:
        """SHA-256 of each text's groups, written `a1,a2|b1;a3|b2`; texts without tokens have ''."""
        a_size, b_size = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
        # a slice's tokens of A stand before its tokens of B
        a_at = np.arange(len(a_ids)) + np.repeat(b_end - b_size, a_size)
        b_at = np.arange(len(b_ids)) + np.repeat(a_end, b_size)
        written = np.zeros((len(a_ids) + len(b_ids), DIGITS + 1), np.uint8)
        written[a_at, :DIGITS], written[b_at, :DIGITS] = self.a_digits[a_ids], self.b_digits[b_ids]
        written[:, DIGITS] = ord(",")
        written[a_at[a_end - 1], DIGITS], written[b_at[b_end - 1], DIGITS] = ord("|"), ord(";")
        there = written != 0
        ends = np.cumsum(np.count_nonzero(there, axis=1))
        text = written[there].tobytes()
        out, first = [""] * len(n_tokens), 0
        for i in np.flatnonzero(n_tokens):
            start, first = (int(ends[first - 1]) if first else 0), first + int(n_tokens[i])
            out[i] = hashlib.sha256(text[start : int(ends[first - 1]) - 1]).hexdigest()
        return out

    def _links(self, a_ids, b_ids) -> np.ndarray:
        """The id pair of each link, in order.

        Between neighbouring ends of either kind lies one token of each, and no two such stretches have the same two tokens: a
        slice of n and m tokens has n + m - 1 links.
        """
        a_end, b_end = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")
        ends = ends[np.diff(ends, prepend=0) > 0]
        return a_ids[np.searchsorted(a_end, ends)] << SHIFT | b_ids[np.searchsorted(b_end, ends)]


def _chunk(number: int, parts: list[tuple[pa.Array, np.ndarray, list[str], np.ndarray]]) -> pa.RecordBatch:
    """A row of `ENCODED` from the ids of the documents of each part and what `Aligner.part` gave for it."""
    found = pa.array(np.concatenate([p[3] for p in parts])).dictionary_encode()
    places = found.indices.to_numpy()
    times = np.bincount(places, minlength=len(found.dictionary))
    n_a, n_b, n_groups = np.concatenate([p[1] for p in parts], axis=1)
    planes = np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    links = pa.compress(pa.py_buffer(planes), codec="zstd", asbytes=True) if len(places) else b""
    digests = [d for p in parts for d in p[2]]
    lists = [found.dictionary, times, pa.concat_arrays([p[0] for p in parts]), n_a, n_b, n_groups, n_a + n_b - n_groups, digests]
    lists = [v if isinstance(v, pa.Array) else pa.array(v) for v in lists]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in lists]
    names = [field.split(" ")[0] for field in ENCODED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([links], pa.binary())], names=names)


_aligners: dict[str, Aligner] = {}


def _aligner(name: str, sources) -> Aligner:
    """The tokenizers, made once in each worker."""
    if name not in _aligners:
        _aligners[name] = Aligner(*sources.value)
    return _aligners[name]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents from rows of `ENCODED` with `rated`, the corpus counts of the chunk's pairs."""
    for batch in batches:
        for row in range(len(batch)):
            got = {name: batch.column(k)[row] for k, name in enumerate(batch.schema.names)}
            links = got["n_links"].values.to_numpy()
            rated = got["rated"].values
            count, best = np.zeros(len(got["pairs"].values or ()), np.int64), np.zeros(len(got["pairs"].values or ()), np.int64)
            if rated is not None and len(rated):
                at = rated.field("pos").to_numpy()
                count[at], best[at] = rated.field("n").to_numpy(), rated.field("best").to_numpy(zero_copy_only=False)
            total = int(links.sum())
            per_link = np.zeros((2, 0), np.int64)
            if total:
                raw = pa.decompress(got["links"].as_py(), decompressed_size=4 * total, codec="zstd", asbytes=True)
                places = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)
                per_link = np.stack([count[places], best[places]])
            sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(per_link, axis=1)], axis=1)
            end = np.cumsum(links)
            count_sum, n_best = sums[:, end] - sums[:, end - links]
            columns = {n: got[n].values for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")}
            columns |= {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": got["groups_sha256"].values}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=["doc_id", *list(columns)[1:]])


def encode_chunks(docs: DataFrame, byte_path: str, piece_path: str, chunk: int = CHUNK) -> DataFrame:
    """A row of `ENCODED` per chunk of texts. The files are read on the driver and sent to the tasks."""
    with open(byte_path, encoding="utf-8") as byte_file, open(piece_path, "rb") as piece_file:
        sources = (byte_file.read(), piece_file.read())
    name = hashlib.sha256(sources[0].encode() + sources[1]).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(sources)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(name, shared), TaskContext.get().partitionId() << 32
        parts, size = [], 0
        for whole in batches:
            for batch in hashing.pieces_of(whole, 1, min(chunk, PART)):
                parts.append((batch.column(0).cast(pa.int64()), *aligner.part(batch.column(1).to_pylist())))
                size += int(hashing.texts_of(batch.column(1))[1][-1])
                if size >= chunk:
                    yield _chunk(number, parts)
                    parts, size, number = [], 0, number + 1
        if parts:
            yield _chunk(number, parts)

    return docs.select("doc_id", "text").mapInArrow(encode, ENCODED)


def align(docs: DataFrame, byte_path: str, piece_path: str, *, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per row of `docs`.

    A is the byte-level vocabulary over space + text, B the sentence pieces over text. Groups end where tokens of both end; links are all
    pairs of an A and a B token that share a byte. count_sum adds up, over a text's links, how many links of the whole
    table have the same two ids; n_best counts the links whose count is the highest of their B id, ties included.

    NULL and empty texts, and texts that the tokens do not give back byte by byte (such as one with the pieces' space mark), have zeros and
    ''. Strings of special tokens are plain text. Repeated rows and rows that share a doc_id or have none count each by itself. Further
    columns are ignored. An empty table gives an empty one. Memory is bounded by a chunk or the longest text.
    """
    chunks = materialize(encode_chunks(docs, byte_path, piece_path, chunk), "chunks")
    flat = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("pos", "x"))
    flat = flat.select("chunk", "pos", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = flat.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)))
    counts = materialize(counts, "pairs")
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    rated = counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    back = flat.select("chunk", "pos", "pair").join(rated, "pair")
    back = back.groupBy("chunk").agg(F.collect_list(F.struct("pos", "n", "best")).alias("rated"))
    joined = chunks.drop("times").join(back, "chunk", "left").drop("chunk")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return joined.mapInArrow(_count, out)
