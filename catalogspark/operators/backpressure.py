"""Freezing discovery in categories whose failures leave their usual range, and thawing it again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ControlLimits:
    """``freeze`` and ``thaw`` are deviations above the mean; between them a category stays as it is. A rate up to ``floor`` never
    freezes one and always thaws it. Mean and deviation forget with the factor ``weight`` a run. The first ``warm_up`` runs only teach."""

    weight: float = 0.3
    freeze: float = 3.0
    thaw: float = 1.0
    floor: float = 0.05
    warm_up: int = 3


def run_history(states: DataFrame, run_no: Column) -> DataFrame:
    """(category, run_no, urls, failures): a row per category and run, from the states that each run left."""
    failed = F.count(F.when(F.col("status") == "failed", F.lit(1)))
    return states.groupBy("category", run_no.alias("run_no")).agg(F.count(F.lit(1)).alias("urls"), failed.alias("failures"))


def control(history: DataFrame, limits: ControlLimits = ControlLimits()) -> DataFrame:
    """(category, run_no, failure_rate, mean, deviation, frozen): what each run decides, with the usual range before it.

    The failure rate of a run is compared with the exponentially weighted mean and deviation of the runs before. Runs in which the
    category is frozen teach nothing, so a long failure does not become usual. ``history`` has one row per category and run; the
    runs of a category, as many as the job has run, are folded in order. Rows without URLs are left out.
    """
    rate = F.col("failures") / F.col("urls")
    runs = history.where("urls > 0").groupBy("category").agg(F.sort_array(F.collect_list(F.struct("run_no", rate.alias("x")))).alias("runs"))
    start = F.struct(
        F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"), F.lit(0).alias("n"), F.lit(False).alias("frozen"),
        F.expr("CAST(array() AS array<struct<run_no:bigint,failure_rate:double,mean:double,deviation:double,frozen:boolean>>)").alias("out"),
    )

    def step(state: Column, run: Column) -> Column:
        x, deviation = run["x"], F.sqrt(state["var"])
        limit = state["mean"] + F.when(state["frozen"], limits.thaw).otherwise(limits.freeze) * deviation
        frozen = (state["n"] >= limits.warm_up) & (x > F.greatest(limit, F.lit(limits.floor)))
        d, w, first = x - state["mean"], limits.weight, state["n"] == 0
        row = F.struct(
            run["run_no"].cast("long").alias("run_no"), x.alias("failure_rate"), state["mean"].alias("mean"),
            deviation.alias("deviation"), frozen.alias("frozen"),
        )
        return F.struct(
            F.when(frozen, state["mean"]).when(first, x).otherwise(state["mean"] + w * d).alias("mean"),
            F.when(frozen, state["var"]).when(first, F.lit(0.0)).otherwise((1 - w) * (state["var"] + w * d * d)).alias("var"),
            (state["n"] + F.when(frozen, 0).otherwise(1)).alias("n"),
            frozen.alias("frozen"),
            F.concat(state["out"], F.array(row)).alias("out"),
        )

    return runs.select("category", F.inline(F.aggregate("runs", start, step, lambda state: state["out"])))


def without_frozen(frontier: DataFrame, decisions: DataFrame, run: Column) -> DataFrame:
    """The frontier of a ``run`` without new URLs of categories that the last run before it froze.

    An as-of join: a decision holds from the next run up to and including the one that decides anew. URLs that are known stay and are
    tried again, which is how a category shows that it works. ``frontier`` has category and is_new; categories without a decision are free.
    """
    until = F.lead("run_no").over(W.partitionBy("category").orderBy("run_no"))
    spans = decisions.withColumn("_until", until).where("frozen").select(F.col("category").alias("_category"), F.col("run_no").alias("_since"), "_until")
    held = (F.col("category") == F.col("_category")) & (F.col("_run") > F.col("_since")) & (F.col("_until").isNull() | (F.col("_run") <= F.col("_until")))
    return frontier.withColumn("_run", run).join(spans, held & F.col("is_new"), "left_anti").drop("_run")
