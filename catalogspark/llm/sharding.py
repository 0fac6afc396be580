"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (native)."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalogspark.llm.common import text_or_empty
from catalogspark.session import materialize

#: The ring has this many positions, and the lookup table one row for each of its equal cells.
RING, CELLS = 1 << 40, 1 << 13


def virtual_nodes(shards: int, per_shard: int) -> list[tuple[int, int]]:
    """(position, shard) of each virtual node in ring order; a node's position does not depend on the shard count."""
    place = lambda s, v: int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:5], "big")
    return sorted((place(s, v), s) for s in range(shards) for v in range(per_shard))


def _cells(spark: SparkSession, nodes: list[tuple[int, int]]) -> DataFrame:
    """For each cell of the ring: the nodes inside it, and the first one after it. Its size depends on the ring alone."""
    width, places = RING // CELLS, [p for p, _ in nodes]
    rows = []
    for cell in range(CELLS):
        first, last = bisect_left(places, cell * width), bisect_left(places, (cell + 1) * width)
        rows.append((cell, [(places[i], i) for i in range(first, last)], last % len(nodes)))
    return spark.createDataFrame(rows, "cell long, inside array<struct<place:long, arc:int>>, after int")


def plan_loads(nodes: list[tuple[int, int]], loads: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, from rank, to rank, shard, first slot) that place every key.

    Each shard first takes the keys of its own arcs, in ring order, up to its capacity. What an arc has
    left goes on clockwise, to the shards of the following nodes that have room.
    """
    room, used, pieces, over = list(capacity), [0] * len(capacity), [], []

    def give(arc: int, start: int, end: int, shard: int) -> int:
        n = min(end - start, room[shard])
        if n:
            pieces.append((arc, start, start + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return start + n

    for arc, (_, shard) in enumerate(nodes):
        start = give(arc, 0, loads[arc], shard)
        if start < loads[arc]:
            over.append((arc, start))
    for arc, start in over:
        step = arc
        while start < loads[arc]:
            step = (step + 1) % len(nodes)
            start = give(arc, start, loads[arc], nodes[step][1])
    return pieces


def in_ranges(placed: DataFrame, order: list[str]) -> DataFrame:
    """`placed`, stored in ranges `part` of its order (arc, *order); `turn` parts equal rows, so that no range is bound to hold a hot key.

    Both steps are stored: a task that is repeated must meet the rows, their turns and the borders of the ranges as they were.
    """
    turned = materialize(placed.withColumn("turn", F.monotonically_increasing_id()), "ring-places")
    return materialize(turned.repartitionByRange("arc", *order, "turn").withColumn("part", F.spark_partition_id()), "ring-ranges")


def place_on_ring(
    docs: DataFrame, key: Column, tie_break: list[str], *, shards: int = 8, nodes_per_shard: int = 512, slack: float = 0.0
) -> DataFrame:
    """`docs` with `shard`, its gapless `slot` in the shard, and `home_shard`, the owner of its place on the ring.

    A key belongs to the first virtual node at or after its position. No shard takes more than
    (1 + slack) * rows / shards rows; with no slack the counts differ by one at most. Keys beyond that
    continue clockwise. Only counts per arc, whose number the ring fixes, reach the driver. An arc is numbered
    in stored ranges, each from where the arc's earlier ranges end, so the rows of one position may fill many tasks.

    Rows with one key share a position and are ordered by `tie_break`; equal rows are interchangeable. An empty
    table gives an empty one. `docs` must not have columns named cell, place, arc, turn, part, before, rank or like the results.
    """
    spark = docs.sparkSession
    nodes = virtual_nodes(shards, nodes_per_shard)
    placed = docs.withColumn("place", F.pmod(key, F.lit(RING))).withColumn("cell", F.floor(F.col("place") / (RING // CELLS)))
    placed = placed.join(F.broadcast(_cells(spark, nodes)), "cell")
    at_or_after = F.filter("inside", lambda n: n.place >= F.col("place"))
    arc = F.coalesce(F.get(at_or_after, F.lit(0))["arc"], F.col("after"))
    placed = placed.withColumn("arc", arc).drop("cell", "inside", "after")
    placed = in_ranges(placed, ["place", *tie_break])
    chunks = placed.groupBy("arc", "part").agg(F.count(F.lit(1)).alias("n"))
    loads = [0] * len(nodes)
    for row in chunks.groupBy("arc").agg(F.sum("n").alias("n")).collect():
        loads[row["arc"]] = row["n"]
    total = sum(loads)
    if slack:
        capacity = [-(-int(total * (1 + slack)) // shards)] * shards
    else:
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = plan_loads(nodes, loads, capacity)
    plan = spark.createDataFrame(pieces, "arc int, start long, end long, shard int, base long")
    owners = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(nodes)], "arc int, home_shard int")
    earlier = F.sum("n").over(Window.partitionBy("arc").orderBy("part")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("arc", "part").orderBy("place", *tie_break, "turn"))
    ranked = placed.withColumn("rank", inside.cast("long") - 1).join(chunks.select("arc", "part", earlier.alias("before")), ["arc", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rank"))
    ranked = ranked.join(F.broadcast(plan.join(owners, "arc")), "arc")
    ranked = ranked.where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end")))
    slot = F.col("base") + F.col("rank") - F.col("start")
    return ranked.withColumn("slot", slot).drop("place", "arc", "turn", "part", "before", "rank", "start", "end", "base")


def shard_documents(docs: DataFrame, *, shards: int = 8, nodes_per_shard: int = 512) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard.

    The law is `rows`: the shards' counts differ by one at most. size is the text's UTF-8 bytes plus one, and
    a NULL text counts as empty. The ring position comes from doc_id; documents without one take theirs from
    the text, so that they spread too. Equal rows are numbered one after the other. Further columns are ignored.
    """
    thin = docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.xxhash64("doc_id"))
    placed = place_on_ring(thin, key, ["doc_id", "size", "text_crc32"], shards=shards, nodes_per_shard=nodes_per_shard)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )
