"""Samples for review that see every stratum, and scores of a judge calibrated against gold labels."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.ordering import first_n
from catalogspark.operators.reports import quality_rolling_mean

STRATA = ("source_category", "extraction_method")


def sample_place(key: str) -> Column:
    """Where a key stands in the order that samples are drawn by: the first digits of its MD5, the same in every run."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("long")


def stratified_sample(rows: DataFrame, k: int, key: str = "sku", strata: tuple[str, ...] = STRATA) -> DataFrame:
    """The ``k`` rows of every stratum that come first in the order of their keys' hashes, so small strata are seen as well.

    Bottom-k samples merge: the sample of a union is that of the united samples, so a stored one is kept up to date
    with new rows alone. A NULL is a stratum of its own. Rows are cut to ``k`` a stratum in every task before the shuffle.
    """
    placed = rows.withColumn("_place", sample_place(key))
    return first_n(placed, list(strata), ["_place", key], k).drop("_place")


def merge_samples(one: DataFrame, other: DataFrame, k: int, key: str = "sku", strata: tuple[str, ...] = STRATA) -> DataFrame:
    """The sample of all rows that two samples were drawn from; a row that is in both counts once."""
    return stratified_sample(one.unionByName(other).dropDuplicates([*strata, key]), k, key, strata)


def calibration(gold: DataFrame, score: str = "score", label: str = "label", steps: int = 100) -> list[tuple[float, float]]:
    """(score, value): the isotonic fit of gold labels on a judge's scores, as steps that never fall.

    Scores count rounded to 1 / ``steps`` of their unit interval or as whole numbers above it, so the fit has a row per level: that, not the number of labels, is what
    reaches the driver. Rows with NULLs teach nothing. Without gold there are no steps.
    """
    known = gold.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    level = F.when(F.abs(score) <= 1, F.round(F.col(score) * steps) / steps).otherwise(F.round(score)).cast("double")
    levels = known.groupBy(level.alias("level")).agg(F.avg(F.col(label).cast("double")).alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
    if levels.isEmpty():
        return []
    model = IsotonicRegression(featuresCol="level", labelCol="mean", weightCol="n").fit(levels)
    return [(float(b), float(v)) for b, v in zip(model.boundaries, model.predictions)]


def calibrated(score: Column, steps: list[tuple[float, float]]) -> Column:
    """The value of the last step at or below a score, or of the first; the score itself without steps."""
    if not steps:
        return score.cast("double")
    bounds, values = (F.array(*[F.lit(x) for x in column]) for column in zip(*steps))
    below = F.size(F.filter(bounds, lambda b: b <= score)) - 1
    return F.when(score.isNotNull(), F.get(values, F.greatest(below, F.lit(0))))


def reviewed_quality(
    rows: DataFrame, gold: DataFrame, k: int, at: str, preceding: int, key: str = "sku", chunk_rows: int = 100_000
) -> DataFrame:
    """The rolling mean of calibrated judge scores over a stratified sample, per source category and method.

    ``rows`` has the strata, ``key``, ``at`` and the judge's score; ``gold`` has score and label. Adds rolling_mean to the sample's rows, whose
    score becomes the calibrated one.
    """
    sample = stratified_sample(rows, k, key)
    judged = sample.withColumn("score", calibrated(F.col("score"), calibration(gold)))
    return quality_rolling_mean(judged, at, [key], preceding, chunk_rows)
