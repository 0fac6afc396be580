"""MinHash near-deduplication with min-max hashing.

Each of 64 hash functions is evaluated once per shingle and gives two signature values, its minimum and its maximum. 32 bands of
four values find candidates: at a similarity of 0.75 a pair shares no band with a probability below 1 in 100,000. Every
link is confirmed on full shingle sets.

Texts with equal sets are one node from the start. Links are then looked for in two steps, both linear in a group's size as long as
its members are alike:

1. Each node is compared with the most central node of its bands, the one that shares the most bands with others.
2. Bands that still hold nodes of several components are searched exhaustively, but only across components, and only
   pairs whose signatures allow the similarity are counted out. Large bands are split into pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm import hashing
from catalogspark.session import materialize

SHINGLE, FUNCTIONS, BAND = 5, 64, 4
NUMERATOR, DENOMINATOR = 75, 100
_RNG = np.random.default_rng(75)
_A = _RNG.integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1, 2**63, FUNCTIONS, dtype=np.uint64)
#: Of 128 signature values two texts of similarity 0.75 share 96 on average; fewer than this with a probability below 1 in 100,000.
LEAST_SHARED = 74
#: Members of a group that one task compares at a time.
BLOCK = 1000

SIGNED = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words, first, _ = hashing.word_hashes(*hashing.texts_of(batch.column("text")))
    return hashing.sorted_sets(*hashing.shingle_hashes(words, first, SHINGLE))


def _set_keys(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit key of each text's set, in two halves; 0 and 0 for an empty set."""
    has = np.diff(offsets) > 0
    set_a, set_b = np.zeros(len(has), np.uint64), np.zeros(len(has), np.uint64)
    if has.any():
        full = offsets[:-1][has]
        set_a[has] = np.add.reduceat(hashing.mix(values ^ _A[0]), full)
        set_b[has] = np.bitwise_xor.reduceat(hashing.mix(values + _B[1]), full) + np.add.reduceat(hashing.mix(values ^ _B[2]), full)
    return set_a, set_b


def _signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each function, a row per text that has shingles: columns min 0, max 0, min 1, ..."""
    full = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(full), 2 * FUNCTIONS), np.uint64)
    for k in range(FUNCTIONS):
        hashed = values * _A[k] + _B[k]
        out[:, 2 * k] = np.minimum.reduceat(hashed, full)
        out[:, 2 * k + 1] = np.maximum.reduceat(hashed, full)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in hashing.pieces_of(whole, whole.schema.get_field_index("text")):
            values, offsets = _sets(batch)
            sizes = np.diff(offsets)
            has = sizes > 0
            set_a, set_b = _set_keys(values, offsets)
            bands, sketches = np.zeros((0, FUNCTIONS * 2 // BAND), np.uint64), np.zeros((0, 2 * FUNCTIONS), np.uint8)
            if has.any():
                found = _signatures(values, offsets)
                sketches = (found >> np.uint64(32)).astype(np.uint8)
                parts = found.reshape(len(found), -1, BAND)
                bands = (parts * hashing.FACTORS[:BAND]).sum(axis=2, dtype=np.uint64)
                bands = hashing.mix(bands + np.arange(bands.shape[1], dtype=np.uint64) * hashing.FACTORS[5])
            at = np.concatenate([[0], np.cumsum(has * bands.shape[1])]).astype(np.int32)
            sketch_at = np.concatenate([[0], np.cumsum(has * 2 * FUNCTIONS)]).astype(np.int32)
            signed = lambda x: pa.array(x.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes.astype(np.int64)), signed(set_a), signed(set_b),
                    pa.ListArray.from_arrays(pa.array(at), signed(np.ascontiguousarray(bands).reshape(-1))),
                    pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(sketch_at), pa.py_buffer(np.ascontiguousarray(sketches))]),
                ],
                names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of the texts whose set is that of the node."""
    for whole in batches:
        for batch in hashing.pieces_of(whole, whole.schema.get_field_index("text")):
            values, offsets = _sets(batch)
            data = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(values)])
            set_a, set_b = (k.view(np.int64) for k in _set_keys(values, offsets))
            own = (set_a == batch.column("set_a").to_numpy()) & (set_b == batch.column("set_b").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("node"), data], names=["node", "shingles"]).filter(pa.array(own))


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The contract on two full sets: 100 * intersection >= 75 * union."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if DENOMINATOR * small < NUMERATOR * large:
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    both = int((b[at] == a).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _with_centre(key: tuple, table: pa.Table) -> pa.Table:
    """Links of the members of one group with its centre, the row that is its own centre."""
    nodes, centre = table["node"].to_pylist(), key[0].as_py()
    sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
    middle = next((s for n, s in zip(nodes, sets) if n == centre), None)
    found = [] if middle is None else [n for n, s in zip(nodes, sets) if n != centre and _linked(s, middle)]
    return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([centre] * len(found), pa.int64())})


def _blocks(table: pa.Table) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Order of the rows, and the slices of it to compare: each block's rows with those after it, or two blocks with one another."""
    side = table["side"].to_numpy()
    order = np.lexsort((table["node"].to_numpy(), side))
    first = int((side == side.min()).sum()) if len(side) else 0
    return order, ([(0, first)] if first == len(side) else [(0, first), (first, len(side))])


def _pairs(order: np.ndarray, slices: list[tuple[int, int]]):
    """For each row of the first slice, the rows to compare it with."""
    (start, end), rest = slices[0], slices[1:]
    for i in range(start, end):
        yield order[i], (order[rest[0][0] : rest[0][1]] if rest else order[i + 1 : end])


def _possible(table: pa.Table) -> pa.Table:
    """The members that may be linked with one of another component, by signatures and set sizes."""
    nodes, parts, sizes = (table[c].to_numpy() for c in ("node", "component", "n_shingles"))
    sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(nodes), -1)
    hit = np.zeros(len(nodes), bool)
    for i, others in _pairs(*_blocks(table)):
        others = others[parts[others] != parts[i]]
        small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[DENOMINATOR * small >= NUMERATOR * large]
        if len(others):
            near = others[(sketches[others] == sketches[i]).sum(axis=1) >= LEAST_SHARED]
            if len(near):
                hit[i] = True
                hit[near] = True
    return table.filter(pa.array(hit)).select(["key", "block_a", "block_b", "side", "node", "component", "n_shingles"])


def _across(table: pa.Table) -> pa.Table:
    """Confirmed links that join the components of one group, found without testing pairs that are joined already."""
    nodes, parts = table["node"].to_numpy(), table["component"].to_numpy()
    sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(nodes), -1)
    sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
    parts, found = parts.copy(), []
    for i, others in _pairs(*_blocks(table)):
        others = others[parts[others] != parts[i]]
        if not len(others):
            continue
        shared = (sketches[others] == sketches[i]).sum(axis=1)
        for j in others[np.argsort(-shared, kind="stable")][: int((shared >= LEAST_SHARED).sum())]:
            if parts[j] != parts[i] and _linked(sets[i], sets[j]):
                found.append((nodes[i], nodes[j]))
                parts[parts == parts[j]] = parts[i]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that the links (a, b) reach, for every node that has a link.

    Alternates the two star steps that hang each node's neighbours on its smallest one. Every step is a grouped minimum and a
    join on thin rows, so no neighbourhood is gathered, and the result of each round is a stored table.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "links")
    state = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, set_a, set_b, text) of the nodes. Texts are found by document and hash; who reads them compares the set, which is exact."""
    wanted = nodes.select("doc_id", "text_hash", "node", "set_a", "set_b")
    return docs.join(wanted, ["doc_id", "text_hash"]).select("node", "set_a", "set_b", "text").dropDuplicates(["node", "text"])


def _of_one_document(real: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of the nodes that occur under one doc_id: each with the smallest of them."""
    key = F.struct("set_a", "set_b")
    several = real.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select("doc_id")
    several = materialize(several, "several")
    held = real.select("doc_id", "set_a", "set_b").join(several, "doc_id", "left_semi").distinct()
    held = materialize(held.join(classes.select("set_a", "set_b", "node"), ["set_a", "set_b"]).select("doc_id", "node"), "held")
    return held.join(held.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of `docs`.

    A text's set is its distinct five-word shingles (A-Z lower-cased); of fewer words it is the whole sequence. Texts are linked at
    100 * intersection >= 75 * union, and component_id is the smallest doc_id that links reach. kept: it is the document's own.

    A NULL or blank text has an empty set and is linked with nothing, not even with another one. Rows without doc_id take no
    part in links and get NULL and kept = true. Rows that share a doc_id are taken as one document: those that have words are
    linked, whatever their texts, so links of each of them count for all; each row carries its own n_shingles. Further columns are ignored. An empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = materialize(docs.mapInArrow(_sign, SIGNED), "signatures")
    real = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # one node per different set; its text is one of its smallest document's
    classes = real.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "text_hash")).alias("text"))
    classes = classes.select("set_a", "set_b", "text.*", F.monotonically_increasing_id().alias("node"))
    classes = materialize(classes, "classes")
    nodes = real.join(classes, ["set_a", "set_b", "doc_id", "text_hash"]).dropDuplicates(["node"])
    nodes = materialize(nodes.select("node", "n_shingles", "bands", "sketch"), "nodes")
    flat = nodes.select("node", F.explode("bands").alias("key"))
    full = flat.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(flat.join(full, "key"), "bands")

    central = members.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = F.struct(F.col("weight"), (-F.col("node")).alias("rank"), F.col("node").alias("centre"))
    weighed = members.join(central, "node")
    centres = weighed.groupBy("key").agg(F.max(ranked).alias("best")).select("key", F.col("best.centre").alias("centre"))
    pairs = members.join(centres, "key").where("node <> centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("shared"))
    best = F.max(F.struct("shared", (-F.col("centre")).alias("rank"), "centre")).alias("best")
    first = materialize(pairs.groupBy("node").agg(best).select("node", F.col("best.centre").alias("centre")), "first")

    candidates = members.select("node").distinct()
    sets = materialize(_texts(docs, classes.join(candidates, "node", "left_semi")).mapInArrow(_shingle_sets, "node long, shingles binary"), "shingles")
    counts = first.groupBy("centre").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    salted = first.join(counts, "centre").select("node", "centre", F.pmod(F.xxhash64("node"), parts).cast("int").alias("salt"))
    copies = counts.select(F.col("centre").alias("node"), "centre", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    compared = salted.unionByName(copies).join(sets, "node").groupBy("centre", "salt")
    links = materialize(compared.applyInArrow(_with_centre, "a long, b long"), "confirmed")

    grouped = materialize(components(links), "components")
    again = _open_groups(members, nodes, grouped, sets)
    links = links.unionByName(materialize(again, "confirmed")).unionByName(_of_one_document(real, classes))
    # links join nodes; a component is named by the smallest document of its nodes
    grouped = materialize(components(links).join(classes.select("node", "doc_id"), "node"), "components")
    named = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    grouped = grouped.join(named, "component").select("node", "component_id")
    by_class = classes.join(grouped, "node", "left").select("set_a", "set_b", F.coalesce("component_id", "doc_id").alias("component_id"))
    joined = signed.join(by_class, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return joined.withColumn("component_id", component).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _open_groups(members: DataFrame, nodes: DataFrame, grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components within bands whose members are not all joined yet."""
    placed = members.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    span = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"))
    # bands with the same members are searched once
    span = span.where("low <> high").groupBy("same").agg(F.min("key").alias("key")).select("key")
    placed = placed.join(span, "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = placed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        "key", F.least("own", "other").alias("block_a"), F.greatest("own", "other").alias("block_b"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "component",
    ).join(nodes.select("node", "n_shingles", "sketch"), "node")
    group = ["key", "block_a", "block_b"]
    shape = "key long, block_a int, block_b int, side int, node long, component long, n_shingles long"
    possible = spread.select(*group, "side", "node", "component", "n_shingles", "sketch").groupBy(*group).applyInArrow(_possible, shape)
    possible = materialize(possible, "possible")
    ready = possible.join(nodes.select("node", "sketch"), "node").join(sets, "node")
    return ready.select(*group, "side", "node", "component", "sketch", "shingles").groupBy(*group).applyInArrow(_across, "a long, b long")
