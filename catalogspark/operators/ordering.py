"""Operators that depend on an order of rows.

Rows of a DataFrame have none, so each takes the order as columns. The last order column should make
the order total; otherwise equal rows are interchangeable.

All of them keep a bounded number of rows per key. Spark prunes to that bound in every map task
before the shuffle, so a key that holds a third of the table reaches its reducer as a few rows per
map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_RANK = "_rank"
_SALT = "_salt"


def _columns(names: str | Column | Sequence[str | Column]) -> list[Column]:
    if isinstance(names, (str, Column)):
        names = [names]
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _ranked_up_to(df: DataFrame, keys: list[Column], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(_RANK, rank).where(F.col(_RANK) <= n)


def first_n(df: DataFrame, keys, order, n: int, rank_as: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key; ``rank_as`` names a column for their rank, from 1.

    Up to ``spark.sql.optimizer.windowGroupLimitThreshold`` rows, Spark prunes before the shuffle.
    A larger ``n`` is first applied per key and salt, so that many tasks share a hot key.
    """
    keys, order = _columns(keys), _columns(order)
    conf = df.sparkSession.conf
    if n > int(conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salts = int(conf.get("spark.sql.shuffle.partitions"))
        salt = F.pmod(F.xxhash64(*[c for c in df.columns if _hashable(df, c)]), F.lit(salts))
        df = _ranked_up_to(df.withColumn(_SALT, salt), [*keys, F.col(_SALT)], order, n).drop(_SALT, _RANK)
    ranked = _ranked_up_to(df, keys, order, n)
    return ranked.withColumnRenamed(_RANK, rank_as) if rank_as else ranked.drop(_RANK)


def _hashable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() not in ("map", "variant")


def first_seen(df: DataFrame, keys, order) -> DataFrame:
    """One row per key, the first in the order: a distinct that keeps the first occurrence."""
    return first_n(df, keys, order, 1)


def latest_by_key(df: DataFrame, keys, order) -> DataFrame:
    """One whole row per key, the last in the order: last write wins."""
    return first_n(df, keys, [c.desc() for c in _columns(order)], 1)


def cap_per_group(df: DataFrame, group, order, n: int | None) -> DataFrame:
    """The first ``n`` rows per group; all rows when ``n`` is None."""
    return df if n is None else first_n(df, group, order, n)


def cap_categories(categories: DataFrame, n: int | None, order: str = "position") -> DataFrame:
    """The first ``n`` categories in discovery order; all when ``n`` is None."""
    return categories if n is None else categories.orderBy(order).limit(n)


def cap_products_per_category(listed: DataFrame, n: int | None, order="rank") -> DataFrame:
    """The first ``n`` URLs of each category in listing order, finished ones included."""
    return cap_per_group(listed, "category", order, n)
