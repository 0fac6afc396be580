"""Rolling means over the rows of a group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalogspark.session import materialize


def row_numbers(df: DataFrame, groups: list[str], at: str, tie_break: list[str]) -> DataFrame:
    """Add ``row_no``, the rank within the group from 1, without sorting a whole group in one task.

    Rows are dealt out and stored once in ranges of group, ``at`` and ``tie_break``, so that a hot group or time is split wherever
    the order columns differ. They are ranked within (group, range) and moved on by the number of rows in
    the group's earlier ranges. NULL is a group of its own, and NULL times come first.
    """
    order = [at, *tie_break]
    dealt = df.repartitionByRange(*[F.col(c) for c in (*groups, *order)]).withColumn("_range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    sizes = dealt.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    renamed = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    starts = sizes.select(*renamed, F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    within = F.row_number().over(W.partitionBy(*groups, "_range").orderBy(*order))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    ranked = dealt.withColumn("_within", within).join(starts, same)
    own = [f"_g{i}" for i in range(len(groups))]
    return ranked.withColumn("row_no", F.col("_start") + F.col("_within")).drop("_range", "_r", "_within", "_start", *own)


def rolling_mean(
    df: DataFrame,
    groups: list[str],
    at: str,
    tie_break: list[str],
    value: str,
    preceding: int,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Add ``rolling_mean`` of ``value`` over the row and the ``preceding`` ones of its group.

    NULL is a group of its own, and NULL times come first. Each group is cut into chunks of consecutive rows, and every chunk also gets the
    rows just before it as context, so the means are exact and no task holds more than a chunk.
    """
    chunk_rows = max(chunk_rows, preceding, 1)
    ranked = row_numbers(df, groups, at, tie_break)
    chunk = F.floor((F.col("row_no") - 1) / chunk_rows)
    is_tail = (F.col("row_no") - 1) % chunk_rows >= chunk_rows - preceding
    copies = F.when(is_tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    spread = ranked.select("*", F.posexplode(copies).alias("_context", "_chunk"))
    frame = W.partitionBy(*groups, "_chunk").orderBy("row_no").rowsBetween(-preceding, 0)
    means = spread.withColumn("rolling_mean", F.avg(value).over(frame))
    return means.where("_context = 0").drop("_context", "_chunk", "row_no")
