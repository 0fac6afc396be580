"""Hierarchical Pitman-Yor language model, sampled by Gibbs over restaurants that are spread over a grid of words and histories.

The model predicts a token from the token before it. Every distinct history has a restaurant of its own, named by its full 64-bit hash,
and all share the root restaurant as their parent, whose base measure is
uniform over the known tokens and one unknown. A customer is a token; a table of a context sends one customer to the root.

The pairs of a word and a context lie in buckets, by a row for the word and a column for the context, so that neither a frequent
word nor a frequent history gathers in one bucket. What couples the buckets are the customers and tables of contexts and words. They
are a distributed table: each round, every bucket sends its shares to parts that own ranges of the hashes,
and gets back the sums over all buckets. Seating within a round uses the totals of the round before, as
distributed Gibbs samplers do. The customers of one (context, word) are unseated
and seated again together: singly up to the 32nd, then in blocks whose rate of new tables is that at the start.

Blocks of documents are the other side. A block sends each bucket its distinct (word, context) pairs with their counts,
which bounds what a frequent word sends, and gets back a probability for each pair. Documents are then summed up in their block.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm import hashing
from catalogspark.session import materialize

#: Logarithms are sent in steps of 1 / STEPS, two bytes each: a token is off by 0.00012 at most, down to a probability of 1e-16.
STEPS = 4096
#: The end of a text, counted as a token, and the history of its first token.
END = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Model:
    """Parameters. `block_bytes` bounds the text that one block holds, `sweeps` those that only warm up, `samples` those averaged."""

    block_bytes: int = 1 << 22
    bucket_bytes: int = 1 << 24
    rounds: int = 2
    sweeps: int = 2
    samples: int = 3
    strength: float = 1.0
    root_strength: float = 10.0
    smoothing: float = 0.1


def _pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<I", len(a.tobytes())) + a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(data: bytes, *types: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for t in types:
        n = struct.unpack_from("<I", raw, at)[0]
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at + 4))
        at += 4 + n
    return out


def held_out(doc_id) -> bool:
    """Whether a document is left out of training: by its id as text, a missing one as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, offsets): the words of each text and its end."""
    words, first, _ = hashing.word_hashes(*hashing.texts_of(batch.column(1)))
    counts = np.diff(first) + 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    tokens = np.full(offsets[-1], END, np.uint64)
    is_word = np.ones(len(tokens), bool)
    is_word[offsets[1:] - 1] = False
    tokens[is_word] = words
    return tokens, offsets


def _grid(buckets: int) -> tuple[int, int]:
    """(rows for words, columns for contexts) of about that many buckets."""
    columns = math.isqrt(buckets - 1) + 1
    return -(-buckets // columns), columns


def _bucket_of(words: np.ndarray, contexts: np.ndarray, grid: tuple[int, int]) -> np.ndarray:
    row = hashing.mix(words + np.uint64(1)) % np.uint64(grid[0])
    return (row * np.uint64(grid[1]) + hashing.mix(contexts + np.uint64(2)) % np.uint64(grid[1])).astype(np.int64)


def _planes(sorted_hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes as steps, byte plane by byte plane, which compresses to the bits that they have."""
    steps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).reshape(-1)


def _from_planes(data: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(data.reshape(8, -1).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _columns(numbers: np.ndarray) -> np.ndarray:
    """Small numbers byte plane by byte plane."""
    return np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).reshape(-1)


def _from_columns(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<i4").reshape(-1)


def _logs(probabilities: np.ndarray) -> np.ndarray:
    """log10 of probabilities in steps, byte plane by byte plane."""
    steps = np.clip(np.rint(np.log10(probabilities) * -STEPS), 0, 65535).astype("<u2")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 2).T).reshape(-1)


def _from_logs(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(2, -1).T).view("<u2").reshape(-1) / -float(STEPS)


class _Block:
    """Documents gathered until they hold `block_bytes` of text, then packed."""

    def __init__(self):
        self.ids, self.sizes, self.tokens, self.bytes = [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        tokens, offsets = _tokens(batch)
        self.ids += batch.column(0).to_pylist()
        self.sizes.append(np.diff(offsets))
        self.tokens.append(tokens)
        self.bytes += len(hashing.texts_of(batch.column(1))[0])

    def row(self) -> tuple[int, bytes]:
        """The block's name and documents: ids, which are missing, sizes, distinct tokens in order, and the place of each token among them."""
        tokens, sizes = np.concatenate(self.tokens), np.concatenate(self.sizes).astype(np.int64)
        missing = np.array([i is None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        # named by its content: equal blocks ask the same and may share their answers
        digest = hashlib.blake2b(digest_size=8)
        for part in (ids, missing, sizes, tokens):
            digest.update(part.tobytes())
        words, index = np.unique(tokens, return_inverse=True)
        return int.from_bytes(digest.digest(), "little") >> 1, _pack(ids, missing.view(np.uint8), sizes, _planes(words), _columns(index))


class _Pairs:
    """The distinct (word, context) pairs of a block, numbered bucket by bucket, in the order in which they are sent.

    A context is named by the full hash of the history, so that no two histories share a restaurant.
    """

    def __init__(self, data: bytes, grid: tuple[int, int]):
        ids, missing, self.sizes, words, index = _unpack(data, "i8", "u1", "i8", "u1", "u1")
        self.ids = [None if m else int(i) for i, m in zip(ids, missing)]
        self.words, index = _from_planes(words), _from_columns(index).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        hashes = hashing.mix(self.words)
        by_hash = np.argsort(hashes)
        self.contexts, rank = hashes[by_hash], np.empty(len(hashes), np.int64)
        rank[by_hash] = np.arange(len(hashes))
        before = np.empty_like(index)
        before[1:] = index[:-1]
        before[self.first] = np.searchsorted(self.words, END)
        pairs, of_token = np.unique(index * len(hashes) + rank[before], return_inverse=True)
        of_word, of_context = np.divmod(pairs, len(hashes))
        bucket = _bucket_of(self.words[of_word], self.contexts[of_context], grid)
        place = np.argsort(bucket, kind="stable")
        self.of_word, self.of_context, self.bucket = of_word[place], of_context[place], bucket[place]
        number = np.empty(len(pairs), np.int64)
        number[place] = np.arange(len(pairs))
        self.of_token = number[of_token]

    def rows(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """What each bucket gets: words, their numbers of pairs, contexts, each pair's place among them, and what is learned of each pair."""
        out = np.array([held_out(i) for i in self.ids])
        learned = np.bincount(self.of_token, ~np.repeat(out, self.sizes), len(self.bucket)).astype(np.int32)
        cuts = np.searchsorted(self.bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[b], cuts[b + 1])
            w, n = np.unique(self.of_word[own], return_counts=True)
            c, of_context = np.unique(self.of_context[own], return_inverse=True)
            yield int(b), _pack(_planes(self.words[w]), n.astype(np.int32), _planes(self.contexts[c]), _columns(of_context), _columns(learned[own]))


PACKED = "block long, bucket int, data binary"


def _packed(block: int, bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=["block", "bucket", "data"]
    )


def _packed_blocks(docs: DataFrame, model: Model) -> DataFrame:
    """A row per block, of bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for whole in batches:
            for batch in hashing.pieces_of(whole, 1):
                block.add(batch)
                if block.bytes >= model.block_bytes:
                    name, data = block.row()
                    yield _packed(name, -1, data)
                    block = _Block()
        if block.ids:
            name, data = block.row()
            yield _packed(name, -1, data)

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


def _sent(grid: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                for bucket, part in _Pairs(data.as_py(), grid).rows(grid[0] * grid[1]):
                    yield _packed(name, bucket, part)

    return run


@dataclass
class _Bucket:
    """The pairs of a bucket in order of word and context, where each word begins, each pair's place among the contexts, and the hashes of both."""

    starts: np.ndarray
    of_word: np.ndarray
    context: np.ndarray
    count: np.ndarray
    words: np.ndarray | None = None
    contexts: np.ndarray | None = None


MERGED = "bucket int, model binary, requests binary"


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    """One row for a bucket: the pairs of all blocks summed up, and for each block which of them it asked for, as steps."""
    words, contexts, counts, sizes, blocks = [], [], [], [], []
    for block, data in zip(rows["block"].to_pylist(), rows["data"].to_pylist()):
        w, n, names, c, k = _unpack(data, "u1", "i4", "u1", "u1", "u1")
        c, k = _from_columns(c), _from_columns(k)
        words.append(np.repeat(_from_planes(w), n))
        contexts.append(_from_planes(names)[c])
        counts.append(k)
        sizes.append(len(c))
        blocks.append(block)
    t, c, k = np.concatenate(words), np.concatenate(contexts), np.concatenate(counts)
    del words, contexts, counts
    order = np.lexsort((c, t))
    t, c, k = t[order], c[order], k[order].astype(np.int64)
    new_word = np.concatenate([[True], t[1:] != t[:-1]])
    new = new_word | np.concatenate([[True], c[1:] != c[:-1]])
    starts = np.flatnonzero(new)
    number = np.empty(len(t), np.int32)
    number[order] = np.cumsum(new) - 1
    cuts = np.cumsum([0, *sizes])
    steps = np.diff(number, prepend=0).astype(np.int32)
    steps[cuts[:-1]] = number[cuts[:-1]]
    names, of_name = np.unique(c[starts], return_inverse=True)
    model = _pack(_planes(t[new_word]), new_word[starts].view(np.uint8), _planes(names), of_name.astype(np.int32), np.add.reduceat(k, starts))
    asked = _pack(np.array(blocks, np.int64), np.array(sizes, np.int64), _columns(steps))
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([model], pa.binary()), "requests": pa.array([asked], pa.binary())})


def _restaurants(data: bytes) -> _Bucket:
    words, new_word, contexts, context, count = _unpack(data, "u1", "u1", "u1", "i4", "i8")
    new_word = new_word.astype(bool)
    return _Bucket(np.flatnonzero(new_word), np.cumsum(new_word) - 1, context.astype(np.int64), count, _from_planes(words), _from_planes(contexts))


@dataclass
class Totals:
    """What buckets share: numbers of the whole model and, for one bucket, the sums over all buckets of its contexts and words.

    `words` has the training count of each word, `elsewhere` its tables in other buckets, none if the bucket has whole words.
    """

    tokens: int
    known: int
    customers: np.ndarray | None
    tables: np.ndarray | None
    discount: float
    root_discount: float
    root_customers: float = 0.0
    root_tables: float = 0.0
    words: np.ndarray | None = None
    elsewhere: np.ndarray | None = None


def _seat(rng: np.random.Generator, count: np.ndarray, discount: float, rate: np.ndarray) -> np.ndarray:
    """Tables of customers who sit down one after the other; `rate` is (strength + discount * tables of all) * parent's probability."""
    tables = np.minimum(count, 1).astype(np.float64)
    live = np.flatnonzero(count > 1)
    seated, step = 1, 1
    while len(live):
        step = 1 if seated < 32 else max(1, seated // 4)
        t, r = tables[live], rate[live]
        new = r / np.maximum(seated - discount * t + r, 1e-12)
        n = np.minimum(step, count[live] - seated)
        tables[live] += (rng.random(len(live)) < new) if step == 1 else rng.binomial(n, np.clip(new, 0, 1))
        seated += step
        live = live[count[live] > seated]
    return tables


class _Sampler:
    """Gibbs sweeps over one bucket."""

    def __init__(self, bucket: _Bucket, totals: Totals, model: Model, seed: int):
        self.b, self.t, self.m = bucket, totals, model
        self.rng = np.random.default_rng(seed)
        self.tables = np.minimum(bucket.count, 1).astype(np.float64)
        self.elsewhere = np.zeros(len(bucket.starts)) if totals.elsewhere is None else totals.elsewhere
        self.sweep_root()

    def sweep_root(self) -> None:
        self.customers = self.elsewhere + np.add.reduceat(self.tables, self.b.starts)
        rate = (self.m.root_strength + self.t.root_discount * self.t.root_tables) / (self.t.known + 1)
        self.root = _seat(self.rng, self.customers.astype(np.int64), self.t.root_discount, np.full(len(self.customers), rate))

    def parent(self) -> np.ndarray:
        """The root's predictive probability of each word."""
        t, m = self.t, self.m
        base = (m.root_strength + t.root_discount * t.root_tables) / (t.known + 1)
        return (self.customers - t.root_discount * self.root + base) / (m.root_strength + t.root_customers)

    def sweep(self) -> None:
        b, t = self.b, self.t
        rate = (self.m.strength + t.discount * t.tables[b.context]) * self.parent()[b.of_word]
        self.tables = _seat(self.rng, b.count, t.discount, rate)
        self.sweep_root()

    def predictive(self) -> np.ndarray:
        """The probability of each pair's word in its context."""
        b, t = self.b, self.t
        own = b.count - t.discount * self.tables
        down = (self.m.strength + t.discount * t.tables[b.context]) * self.parent()[b.of_word]
        return (own + down) / (self.m.strength + t.customers[b.context])


#: Of one bucket and part: the bucket's words and contexts in the part's range of hashes, with their shares or sums. Bucket -1 has the part's numbers.
SHARES = "bucket int, part int, data binary, numbers array<double>"


def _share_rows(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64())]
    columns = zip(*rows) if rows else [[]] * 4
    return pa.table({n: pa.array(list(c), t) for n, c, t in zip(("bucket", "part", "data", "numbers"), columns, types)})


def _cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Each part's bounds among sorted hashes."""
    return np.searchsorted((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def _shares(bucket: int, b: _Bucket, tables: np.ndarray, numbers: list[float], parts: int) -> list[tuple]:
    """A row per part with the customers and tables that the bucket adds to the part's words and contexts, and one with its numbers."""
    tables = tables.astype(np.int64)
    word = np.add.reduceat(b.count, b.starts), np.add.reduceat(tables, b.starts)
    context = (np.bincount(b.context, k, len(b.contexts)).astype(np.int64) for k in (b.count, tables))
    sides = [(b.words, *word), (b.contexts, *context)]
    cuts = [_cuts(side[0], parts) for side in sides]
    rows = [(bucket, 0, None, numbers)]
    for part in range(parts):
        own = [[a[c[part] : c[part + 1]] for a in side] for c, side in zip(cuts, sides)]
        if len(own[0][0]) + len(own[1][0]):
            rows.append((bucket, part, _pack(*(x for names, *values in own for x in (_planes(names), *values))), None))
    return rows


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    """The sums of all buckets' shares, returned to each bucket for what it sent (of a word's tables those of the other buckets only).

    Numbers: the three of the buckets; the words' customers and tables; words with customers, with one table, with two.
    """
    part, sent, numbers = key[0].as_py(), [], np.zeros(8)
    for bucket, data, own in zip(table["bucket"].to_pylist(), table["data"].to_pylist(), table["numbers"].to_pylist()):
        if data is None:
            numbers[:3] += own
        else:
            sent.append((bucket, _unpack(data, "u1", "i8", "i8", "u1", "i8", "i8")))
    sums: list[list[np.ndarray]] = [[] for _ in sent]
    for side in (0, 3):
        hashes = [_from_planes(arrays[side]) for _, arrays in sent]
        names, of_name = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]), return_inverse=True)
        cuts = np.cumsum([0, *map(len, hashes)])
        for k in (1, 2):
            shares = np.concatenate([*(arrays[side + k] for _, arrays in sent), np.zeros(0, np.int64)])
            # bincount adds doubles, which is exact below 2 ** 53
            total = np.bincount(of_name, shares, len(names)).astype(np.int64)
            others = total[of_name] - (shares if (side, k) == (0, 2) else 0)
            for own, i, j in zip(sums, cuts[:-1], cuts[1:]):
                own.append(others[i:j])
            if side == 0:
                numbers[3 + k - 1] = total.sum()
                numbers[5 + k - 1] = (total > 0).sum() if k == 1 else (total == 1).sum()
        if side == 0:
            numbers[7] = (total == 2).sum()
    rows = [(-1, part, None, numbers.tolist())]
    return _share_rows(rows + [(bucket, part, _pack(*own), None) for (bucket, _), own in zip(sent, sums)])


def _exchanged(shares: DataFrame, name: str) -> tuple[DataFrame, list[float]]:
    """(sums for each bucket and part, the numbers summed over parts): the one row of numbers is all that the driver sees."""
    sums = materialize(shares.groupBy("part").applyInArrow(_summed, SHARES), name)
    total = sums.where("bucket = -1").agg(*[F.sum(F.col("numbers")[i]).alias(f"n{i}") for i in range(8)])
    return sums.where("bucket >= 0"), [x or 0.0 for x in total.first()]


def _local(totals: Totals, sums: list[tuple[int, bytes]]) -> Totals:
    """The totals with the sums of a bucket's words and contexts; parts are ranges, so in their order the sums are too."""
    arrays = [_unpack(data, "i8", "i8", "i8", "i8") for _, data in sorted(sums, key=lambda x: x[0])]
    words, elsewhere, customers, tables = (np.concatenate(a).astype(np.float64) for a in zip(*arrays))
    return replace(totals, customers=customers, tables=tables, words=words, elsewhere=elsewhere)


def _joined(buckets: DataFrame, sums: DataFrame, visit, schema: str) -> DataFrame:
    """`visit` of each bucket's rows and its sums."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sums, own = [], None
        for row in table.to_pylist():
            if row["part"] < 0:
                own = row
            else:
                sums.append((row["part"], row["data"]))
        return visit(key[0].as_py(), own, sums)

    rows = buckets.withColumn("part", F.lit(-1))
    return rows.unionByName(sums.drop("numbers"), allowMissingColumns=True).groupBy("bucket").applyInArrow(run, schema)


def _discount(singles: float, doubles: float) -> float:
    """The usual estimate from how many counts are one and two, kept off its ends."""
    return min(0.95, max(0.05, singles / max(1.0, singles + 2 * doubles)))


def train(buckets: DataFrame, parts: int, model: Model) -> tuple[Totals, DataFrame]:
    """Sweep all buckets, `rounds` times with fresh totals; `buckets` has a row per bucket. Returns the numbers, and the sums for each bucket."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = _restaurants(data.as_py())
                numbers = [float((b.count == 1).sum()), float((b.count == 2).sum()), 0.0]
                yield from _share_rows(_shares(bucket, b, np.minimum(b.count, 1), numbers, parts)).to_batches()

    sums, n = _exchanged(buckets.select("bucket", "model").mapInArrow(first, SHARES), "lm-sums")
    # a word's first tables are the contexts it occurs in
    totals = Totals(int(n[3]), int(n[5]), None, None, _discount(n[0], n[1]), _discount(n[6], n[7]), n[4], n[5])
    for round_ in range(model.rounds):

        def seat(bucket: int, row: dict, sums: list[tuple[int, bytes]], totals: Totals = totals, round_: int = round_) -> pa.Table:
            b = _restaurants(row["model"])
            sampler = _Sampler(b, _local(totals, sums), model, bucket * 1009 + round_)
            for _ in range(model.sweeps):
                sampler.sweep()
            # each bucket seats the root for its words; a word's root tables count by the bucket's share of its customers
            share = np.add.reduceat(sampler.tables, b.starts) / np.maximum(sampler.customers, 1.0)
            return _share_rows(_shares(bucket, b, sampler.tables, [0.0, 0.0, float((sampler.root * share).sum())], parts))

        sums, n = _exchanged(_joined(buckets.select("bucket", "model"), sums, seat, SHARES), "lm-sums")
        totals = replace(totals, root_customers=n[4], root_tables=n[2])
    return totals, sums


def _answers(totals: Totals, model: Model):
    def answer(bucket: int, row: dict, sums: list[tuple[int, bytes]]) -> pa.Table:
        """For each block, the log10 probability of each pair that it asked for, and the training count of its word."""
        b, local = _restaurants(row["model"]), _local(totals, sums)
        sampler = _Sampler(b, local, model, bucket * 1009 + 997)
        for _ in range(model.sweeps):
            sampler.sweep()
        mean = np.zeros(len(b.count))
        for _ in range(model.samples):
            sampler.sweep()
            mean += sampler.predictive() / model.samples
        words = local.words.astype(np.int64)
        blocks, sizes, steps = _unpack(row["requests"], "i8", "i8", "u1")
        steps, at, out = _from_columns(steps), 0, {}
        for block, size in zip(blocks.tolist(), sizes.tolist()):
            pairs = np.cumsum(steps[at : at + size])
            at += size
            if block in out:
                continue
            of_word = b.of_word[pairs]
            new = np.concatenate([[True], of_word[1:] != of_word[:-1]])
            n = np.diff(np.append(np.flatnonzero(new), len(pairs)))
            out[block] = _pack(_logs(mean[pairs]), _columns(words[of_word[new]] >> 31), _columns(words[of_word[new]] & 0x7FFFFFFF), _columns(n))
        columns = [pa.array(list(out), pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array(list(out.values()), pa.binary())]
        return pa.table(columns, names=["block", "bucket", "data"])

    return answer


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(totals: Totals, grid: tuple[int, int], model: Model):
    names = [c.split()[0] for c in SCORES.split(", ")]

    def score(table: pa.Table) -> pa.Table:
        """The scores of one block's documents, from its own row and the answers of all buckets."""
        rows = sorted(zip(table["bucket"].to_pylist(), table["data"].to_pylist()))
        own = [d for b, d in rows if b == -1]
        logs, counts = [], []
        for _, data in rows[len(own) :]:
            s, high, low, n = _unpack(data, "u1", "u1", "u1", "u1")
            logs.append(_from_logs(s))
            words = _from_columns(high).astype(np.int64) << 31 | _from_columns(low)
            counts.append(np.repeat(words, _from_columns(n)))
        logs, counts = np.concatenate(logs), np.concatenate(counts)
        base = np.log10((counts + model.smoothing) / (totals.tokens + model.smoothing * (totals.known + 1)))
        # equal blocks of repeated rows asked the same
        parts = []
        for data in own:
            p = _Pairs(data, grid)
            parts.append(pa.table([
                pa.array(p.ids, pa.int64()), pa.array([held_out(i) for i in p.ids]), pa.array(p.sizes),
                pa.array(np.add.reduceat((counts[p.of_token] > 0).astype(np.int64), p.first)), pa.array(np.full(len(p.ids), totals.tokens, np.int64)),
                pa.array(np.add.reduceat(base[p.of_token], p.first)), pa.array(np.add.reduceat(logs[p.of_token], p.first)),
            ], names=names))
        return pa.concat_tables(parts)

    return score


def score_texts(docs: DataFrame, model: Model = Model()) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents whose crc32(doc_id as text) is no multiple of 10; score is its log10 probability of the
    whole text, averaged over samples, base_score that of smoothed token counts. Perplexity is 10 ** (-score / n_tokens).

    A NULL or empty text is its end alone. A missing doc_id counts as the empty text, whose crc32 is 0, so it is held out. Repeated rows each
    count and get equal scores. Further columns are ignored. If nothing is learned from, every token is unknown and the scores are
    those of the base measure. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    grid = _grid(max(8, -(-size // model.bucket_bytes)))
    blocks = materialize(_packed_blocks(docs, model), "lm-blocks")
    if not blocks.limit(1).count():
        return spark.createDataFrame([], SCORES)
    merged = materialize(blocks.mapInArrow(_sent(grid), PACKED).groupBy("bucket").applyInArrow(_merge, MERGED), "lm-buckets")
    totals, sums = train(merged, grid[0] * grid[1], model)
    answers = _joined(merged, sums, _answers(totals, model), PACKED)
    return blocks.unionByName(answers).groupBy("block").applyInArrow(_scored(totals, grid, model), SCORES)
