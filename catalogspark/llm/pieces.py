"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled to a machine over characters: the normaliser (white space to its marker, a marker in front), an arc
for each piece, and an arc of its bytes, or the unknown one, for a character that is no piece by itself. A text composed with it is a lattice, and its
encoding the shortest path in the tropical semiring.

- Unigram models: an arc weighs minus the piece's score, that of an unknown character 10 more than the worst piece, and a user-defined
  piece's 0.1, so that it comes first. Neighbouring unknown characters give one id.
- Merge (BPE) models: arcs weigh nothing, but the machine remembers the last piece, and two pieces may follow one another only if
  merging would leave them apart. Exactly one path of a text then has finite weight, so the first one that a
  depth-first search completes is the shortest. Runs of white-space markers, whose merges have equal scores and are
  taken from the left, are merged directly.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.llm.common import packed

MARK = "▁"
#: Fixed values of the model format: types of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Fixed value: what an unknown character weighs more than the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
#: Encodings of segments that a worker remembers, twice this many at most.
REMEMBERED = 150_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Machine:
    """A compiled model: plain tables, small enough to send to every task (their size is the vocabulary's)."""

    kind: int
    names: list[str]
    cost: list[float]
    arcs: dict[str, int]
    byte_ids: list[int]
    unknown: int
    dummy_prefix: bool
    longest: int
    unknown_cost: float = 0.0
    rank: dict[int, int] = field(default_factory=dict)
    halves: dict[int, tuple[int, int]] = field(default_factory=dict)
    apart: dict[tuple[int, int], bool] = field(default_factory=dict)
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)
    older: dict[str, tuple[int, ...]] = field(default_factory=dict)
    longest_from: dict[str, int] = field(default_factory=dict)

    # --- encoding ---------------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        """Spaces become markers, with one in front of a text that is not empty. A marker in the text counts as a space."""
        text = text.replace(" ", MARK)
        return MARK + text if text and self.dummy_prefix else text

    def encode(self, text: str) -> array:
        out, known, older = array("i"), self.known, self.older
        if not text:
            return out
        if self.dummy_prefix and "  " not in text and text[0] != " " and MARK not in text and text[-1] != " ":
            segments = text.split(" ")  # each stands for a marker and the word
        else:
            segments = [s[1:] if s[0] == MARK and MARK not in s[1:] else (s,) for s in _segments(self.normalise(text))]
        for s in segments:
            ids = known.get(s)
            if ids is None:
                ids = older.get(s)
                if ids is None:
                    ids = tuple(self.shortest_path(s[0] if isinstance(s, tuple) else MARK + s))
                if len(known) >= REMEMBERED:
                    # the older half goes; what is used again comes back from it
                    self.older, self.known = known, {}
                    known, older = self.known, self.older
                known[s] = ids
            out.extend(ids)
        if not self.byte_ids and self.unknown in out:
            unknown = self.unknown
            return array("i", [i for k, i in enumerate(out) if i != unknown or not k or out[k - 1] != unknown])
        return out

    def shortest_path(self, segment: str) -> list[int]:
        """Ids on the shortest path of the machine composed with a segment, which no piece crosses the ends of."""
        if self.kind != BPE:
            return self._cheapest(segment)
        out: list[int] = []
        at, arcs = 0, self.arcs
        while at < len(segment):
            end = at
            while end < len(segment) and segment[end] in arcs:
                end += 1
            if end > at:
                part = segment[at:end]
                if MARK * 2 in part:
                    out += self.merge(part)
                else:
                    out += self._only_path(part)
            if end < len(segment):
                out += [self.byte_ids[b] for b in segment[end].encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]
            at = end + 1
        return out

    def _cheapest(self, part: str) -> list[int]:
        """Tropical shortest distances from the left, then the path back; of equal paths the one whose last arc starts further left."""
        n, arcs = len(part), self.arcs
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)] + [(float("inf"), 0, -1)] * n
        for i in range(n):
            for j in range(i + 1, min(n, max(i + self.longest, i + 1)) + 1):
                piece = arcs.get(part[i:j])
                if piece is not None:
                    cost = best[i][0] + self.cost[piece]
                elif j == i + 1:
                    piece, cost = -1, best[i][0] + self.unknown_cost
                else:
                    continue
                if cost < best[j][0]:
                    best[j] = (cost, i, piece)
        out, at = [], n
        while at:
            _, start, piece = best[at]
            if piece >= 0:
                out.append(piece)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in reversed(part[start].encode("utf-8", "surrogatepass"))]
            else:
                out.append(self.unknown)
            at = start
        return out[::-1]

    def _only_path(self, part: str) -> list[int]:
        """The one path whose neighbours may all follow one another: depth first, longest arcs first, dead ends left for good."""
        n, arcs = len(part), self.arcs
        whole = arcs.get(part) if n <= self.longest else None
        if whole is not None:
            return [whole]
        path, ends, dead = [], [0], set()
        longest_from = self.longest_from
        at, reach = 0, min(n, longest_from.get(part[:4]) or longest_from.get(part[:3], 2))
        while at < n:
            for j in range(reach, at, -1):
                piece = arcs.get(part[at:j])
                if piece is not None and j not in dead and (not path or self.may_follow(path[-1], piece)):
                    path.append(piece)
                    ends.append(j)
                    at, reach = j, min(n, j + (longest_from.get(part[j : j + 4]) or longest_from.get(part[j : j + 3], 2)))
                    break
            else:
                if not path:
                    return self.merge(part)
                dead.add(at)
                path.pop()
                ends.pop()
                reach, at = at - 1, ends[-1]
        return path

    def may_follow(self, a: int, b: int) -> bool:
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) >= 4 * REMEMBERED:
                self.apart.clear()
            found = self.apart[a, b] = self._stay_apart(a, b)
        return found

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether no merge ever joins what lies left and right of the border of two pieces.

        Undoes the merges of both pieces from the last to the first and looks at each stage whether the pieces then at the border
        would have been joined before the merge that is undone.
        """
        before = len(self.rank) + 1
        while True:
            joined = self.arcs.get(self.names[a] + self.names[b])
            if joined is not None and joined in self.rank and self.rank[joined] < before:
                return False
            last_a = self.rank[a] if a in self.halves else -1
            last_b = self.rank[b] if b in self.halves else -1
            if last_a < 0 and last_b < 0:
                return True
            if last_a > last_b:
                # undone on the left: an equal rank at the border comes later than this merge
                before, a = last_a, self.halves[a][1]
            else:
                # undone on the right: of equal ranks the one at the border is further left and comes first
                before, b = last_b + 1, self.halves[b][0]

    def merge(self, part: str) -> list[int]:
        """The merges of a BPE model carried out one by one: the best score first, of equal ones the leftmost."""
        symbols: list[str | None] = list(part)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0:
                both = symbols[i] + symbols[j]
                piece = self.arcs.get(both)
                if piece is not None:
                    heapq.heappush(heap, (self.cost[piece], i, both))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if symbols[i] is None or j < 0 or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [self.arcs[s] for s in symbols if s is not None]

    # --- decoding ---------------------------------------------------------------------------------

    def decode(self, ids) -> str:
        """The text that ids stand for. Bytes that are no UTF-8 become replacement characters."""
        table = self.__dict__.get("_bytes")
        if table is None:
            byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
            table = self._bytes = [byte_of.get(i, n.encode("utf-8", "surrogatepass")) for i, n in enumerate(self.names)]
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


_SEGMENTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _segments(text: str) -> list[str]:
    """Parts that no piece crosses the ends of: no piece has a marker after another character."""
    return _SEGMENTS.findall(text)


def compile_model(data: bytes) -> Machine:
    """Compile the bytes of a model file. The normaliser must be the identity, which is what merge models with byte fallback use."""
    names, cost, types, kind, rules, dummy, trim = [], [], [], UNIGRAM, b"", True, True
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            names.append(piece[1].decode())
            cost.append(-struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            types.append(piece.get(3, NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            rules, dummy, trim = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if rules or trim or kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and merge models with an identity normaliser are supported")
    arcs = {n: i for i, (n, t) in enumerate(zip(names, types)) if t in (NORMAL, USER_DEFINED)}
    if any(MARK in n.lstrip(MARK) for n in arcs):
        raise ValueError("a piece has a white-space marker after another character")
    byte_ids = [names.index(f"<0x{b:02X}>") for b in range(256)] if BYTE in types else []
    machine = Machine(
        kind, names, cost, arcs, byte_ids, types.index(UNKNOWN) if UNKNOWN in types else 0, dummy, max(map(len, arcs), default=0)
    )
    if kind == BPE:
        _derive(machine)
    else:
        normal = [c for c, t in zip(cost, types) if t == NORMAL]
        machine.unknown_cost = max(normal, default=0.0) + UNKNOWN_PENALTY
        for i, (name, t) in enumerate(zip(names, types)):
            if t == USER_DEFINED:
                cost[i] = len(name.encode()) * min([0.0, *normal]) + 0.1
    return machine


def _derive(machine: Machine) -> None:
    """Rank the pieces by score and find the two halves whose merge makes each; pieces that merging never makes lose their arc."""
    order = sorted(machine.arcs.values(), key=lambda i: machine.cost[i])
    rank = 0
    for k, piece in enumerate(order):
        rank = k if k == 0 or machine.cost[piece] != machine.cost[order[k - 1]] else rank
        machine.rank[piece] = rank
    made, whole = {}, machine.arcs
    for name, piece in whole.items():
        if len(name) > 1:
            machine.arcs = _Without(whole, name)
            made[piece] = machine.merge(name)
    machine.arcs = {n: i for n, i in whole.items() if len(n) == 1 or len(made[i]) == 2}
    machine.halves = {i: tuple(made[i]) for n, i in machine.arcs.items() if len(n) > 1}
    for name in machine.arcs:
        # pieces by their first four characters, and those of three by themselves
        if len(name) >= 3:
            machine.longest_from[name[:4]] = max(len(name), machine.longest_from.get(name[:4], 3))


class _Without(dict):
    """A dictionary without one key."""

    def __init__(self, whole: dict, key: str):
        super().__init__()
        self.whole, self.key = whole, key

    def get(self, key, default=None):
        return default if key == self.key else self.whole.get(key, default)

    def __getitem__(self, key):
        return self.whole[key]


def with_tokens(docs: DataFrame, model_path: str, *, ids: str = "token_ids", count: str = "n_tokens", round_trip: str = "round_trip") -> DataFrame:
    """`docs` with three columns: the ids of the text's pieces, their number, and whether decoding them gives the text back.

    The file is read on the driver, and its compiled tables are sent to the tasks, so executors need not have it. A
    row's whole text is encoded; memory is bounded by one Arrow batch and a memory of segments. A NULL text gets
    NULLs, an empty one no ids. The white-space marker itself counts as a space, so a text that has it does not come back the same. Rows are
    independent, so repeated rows and extra columns are kept as they are; columns named like the results are replaced.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        shared = spark.sparkContext.broadcast(compile_model(file.read()))
    extra = {ids: T.ArrayType(T.IntegerType()), count: T.LongType(), round_trip: T.BooleanType()}
    kept = [c for c in docs.columns if c not in extra]
    rows = packed(docs.select(*[f"`{c}`" for c in kept])).select("_row", "_row.text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            texts = batch.column(1)
            values, offsets, same = array("i"), [0], []
            missing = texts.is_null().to_pylist()
            for value in texts:
                text = value.as_py()
                if text is None:
                    same.append(None)
                else:
                    found = machine.encode(text)
                    same.append(machine.decode(found) == text)
                    values.extend(found)
                offsets.append(len(values))
            at = pa.array([None if m else o for m, o in zip([*missing, False], offsets)], pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.Array.from_buffers(pa.int32(), len(values), [None, pa.py_buffer(values)]))
            counts = pa.array([None if m else b - a for m, a, b in zip(missing, offsets, offsets[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, counts, pa.array(same, pa.bool_())], names=["_row", "_ids", "_count", "_same"]
            )

    fields = [T.StructField("_row", rows.schema["_row"].dataType)]
    fields += [T.StructField(n, t) for n, t in zip(("_ids", "_count", "_same"), extra.values())]
    out = rows.mapInArrow(encode, T.StructType(fields))
    return out.select("_row.*", F.col("_ids").alias(ids), F.col("_count").alias(count), F.col("_same").alias(round_trip))
