"""Backpressure, review samples and the layout of states against plain Python, and the plans they must have."""

import random
import re
from datetime import datetime
from math import sqrt

from pyspark.sql import functions as F

from catalogspark.operators.backpressure import ControlLimits, control, run_history, without_frozen
from catalogspark.operators.frontier import get_state, select_frontier, urls_by_status
from catalogspark.operators.review import calibrated, calibration, merge_samples, reviewed_quality, stratified_sample
from catalogspark.plans.cascade import read_static, without_older_copies
from catalogspark.sources.layout import store_states


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def folded(rates, limits):
    mean = var = n = 0
    frozen, out = False, []
    for x in rates:
        deviation = sqrt(var)
        frozen = n >= limits.warm_up and x > max(mean + (limits.thaw if frozen else limits.freeze) * deviation, limits.floor)
        out.append((x, mean, deviation, frozen))
        if not frozen:
            d = x - mean
            mean, var, n = (x, 0, 1) if n == 0 else (mean + limits.weight * d, (1 - limits.weight) * (var + limits.weight * d * d), n + 1)
    return out


def test_control_of_failure_rates(spark):
    rng, limits = random.Random(3), ControlLimits()
    rates = {"calm": [10] * 8, "spike": [10, 12, 9, 11, 60, 55, 10, 10], "low": [0, 0, 0, 0, 4, 0, 0, 0], "new": [90], "wild": [rng.randrange(100) for _ in range(30)]}
    rows = [(c, r, 100, x) for c, xs in rates.items() for r, x in enumerate(xs)] + [("none", 1, 0, 0)]
    rng.shuffle(rows)
    history = spark.createDataFrame(rows, "category string, run_no long, urls long, failures long")
    got = {}
    for r in control(history, limits).orderBy("run_no").collect():
        got.setdefault(r.category, []).append((r.failure_rate, r.mean, r.deviation, r.frozen))
    assert got == {c: folded([x / 100 for x in xs], limits) for c, xs in rates.items()}
    assert [f for *_, f in got["spike"]] == [False] * 4 + [True, True, False, False]
    assert not any(f for *_, f in got["low"] + got["calm"] + got["new"])
    assert control(history.limit(0)).count() == 0


def test_frozen_categories_leave_the_frontier_and_come_back(spark):
    decisions = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 4, True), ("a", 5, False), ("b", 3, True)], "category string, run_no long, frozen boolean")
    rows = [(u, c, new, run) for run in range(1, 8) for u, c, new in (("x", "a", True), ("y", "a", False), ("z", "b", True), ("w", "c", True), ("v", None, True))]
    frontier = spark.createDataFrame(rows, "url string, category string, is_new boolean, run long")
    kept = {(r.url, r.run) for r in without_frozen(frontier, decisions, F.col("run")).collect()}
    gone = {("x", 3), ("x", 4), ("x", 5), ("z", 4), ("z", 5), ("z", 6), ("z", 7)}
    assert kept == {(u, run) for u, _, _, run in rows} - gone


def test_history_counts_states(spark):
    states = spark.createDataFrame([("a", "failed"), ("a", "done"), ("a", None), ("b", "done")], "category string, status string")
    assert sorted(map(tuple, run_history(states, F.lit(4)).collect())) == [("a", 4, 3, 1), ("b", 4, 1, 0)]


def products(spark, n, start=0):
    return spark.range(start, start + n).select(
        F.col("id").cast("string").alias("sku"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "rare").otherwise("usual").alias("source_category"),
        F.when(F.col("id") % 7 == 0, None).otherwise("dom").alias("extraction_method"),
    )


def test_samples_see_every_stratum_and_merge(spark):
    whole, one, other = products(spark, 3000), products(spark, 1800), products(spark, 1400, 1600)
    sample = {tuple(r) for r in stratified_sample(whole, 12).collect()}
    sizes = {}
    for _, *stratum in sample:
        sizes[tuple(stratum)] = sizes.get(tuple(stratum), 0) + 1
    assert len(sizes) == 6 and sizes[("rare", None)] <= 12 and all(n == 12 for s, n in sizes.items() if s[0] != "rare")
    merged = merge_samples(stratified_sample(one, 12), stratified_sample(other, 12), 12)
    assert {tuple(r) for r in merged.collect()} == sample


def isotonic(points):
    """The fit by its definition: for each level the highest low of the means of spans around it."""
    levels = sorted({s for s, _ in points})
    mean = lambda a, b: (lambda ys: sum(ys) / len(ys))([y for s, y in points if a <= s <= b])
    return {x: max(min(mean(a, b) for b in levels if b >= x) for a in levels if a <= x) for x in levels}


def test_calibration_against_the_definition(spark):
    rng = random.Random(5)
    points = [(s, float(min(1, max(0, s / 10 + rng.choice([-0.4, 0, 0.3]))))) for s in (rng.randrange(11) for _ in range(200)) if s != 6]
    gold = spark.createDataFrame([*points, (None, 1.0), (3, None)], "score int, label double")
    steps, want = calibration(gold), isotonic(points)
    scores = spark.createDataFrame([(float(s) / 2,) for s in range(-2, 24)] + [(None,)], "score double")
    for score, value in scores.select("score", calibrated(F.col("score"), steps).alias("v")).collect():
        if score is None:
            assert value is None
        else:
            below = [x for x in want if x <= score] or [min(want)]
            assert abs(value - want[max(below)]) < 1e-9
    assert calibration(gold.limit(0)) == []
    assert [r[0] for r in scores.select(calibrated(F.col("score"), [])).collect()] == [r.score for r in scores.collect()]


def test_reviewed_quality_of_odd_rows(spark):
    rows = products(spark, 60).withColumn("score", F.col("sku").cast("int") % 5).withColumn("at", F.col("sku").cast("int"))
    gold = spark.createDataFrame([(i % 5, float(i % 5 > 2)) for i in range(50)], "score int, label double")
    got = reviewed_quality(rows, gold, 5, "at", 2).collect()
    assert {r.score for r in got} <= {0.0, 1.0} and all(0 <= r.rolling_mean <= 1 for r in got)
    assert reviewed_quality(rows.limit(0), gold, 5, "at", 2).count() == 0


def states(spark, n=4000):
    status = F.element_at(F.array(*map(F.lit, ("done", "failed", "discovered"))), (F.col("id") % 3 + 1).cast("int"))
    return spark.range(n).select(
        F.concat(F.lit("u"), "id").alias("url"), F.lit("c").alias("category"), status.alias("status"),
        F.lit(None).cast("string").alias("sku"), F.lit(None).cast("string").alias("error"), F.lit(datetime(2024, 1, 1)).alias("updated_at"),
    )


def test_laid_out_states_are_joined_as_they_lie(spark, tmp_path):
    laid = store_states(states(spark), "laid_out", str(tmp_path / "t"), buckets=5)
    listed = spark.range(3900, 4100).select(F.concat(F.lit("u"), "id").alias("url"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frontier = select_frontier(listed, laid)
        text = plan(frontier)
        found = {(r.url, r.prior_status) for r in frontier.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning(url") == 1 and "Bucketed: true" in text
    scan = text.index("FileScan parquet")
    assert "Exchange" not in text[text.rindex("\n", 0, scan) : scan]  # the states' side goes from the scan to the join
    plain = {(r.url, r.prior_status) for r in select_frontier(listed, states(spark)).collect()}
    assert found == plain and len(plain) > 100


def test_lookups_open_few_files(spark, tmp_path):
    laid = store_states(states(spark), "looked_up", str(tmp_path / "t"), buckets=5)
    one = get_state(laid, "u77")
    assert [r.status for r in one.collect()] == ["discovered"]
    assert "PushedFilters: [IsNotNull(url), EqualTo(url,u77)]" in plan(one)
    # the planner passes over buckets it needs no order of, but still opens only the files of the URL's bucket
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 5" in plan(get_state(laid, "u77"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    failed = urls_by_status(laid, "failed")
    assert failed.count() == 1333 and re.search(r"PartitionFilters: \[.*status.*failed", plan(failed))
    store_states(states(spark, 30), "looked_up", str(tmp_path / "t"), buckets=5)
    assert spark.table("looked_up").count() == 30


def test_older_copies_are_left_out_before_extraction(spark, tmp_path):
    at = lambda day: None if day is None else datetime(2024, 1, day)
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z"), ("a", None, "n"), ("b", None, "p"), ("b", None, "q"), ("c", 2, "r")]
    pages = spark.createDataFrame([(u, at(d), h, None) for u, d, h in rows], "url string, fetched_at timestamp, html string, fetch_error string")
    assert sorted(r.html for r in without_older_copies(pages).collect()) == ["p", "q", "r", "y", "z"]
    assert without_older_copies(pages.drop("fetched_at")).count() == 7
    many = pages.crossJoin(spark.range(50)).withColumn("fetched_at", F.expr("fetched_at + make_interval(0, 0, 0, int(id))"))
    many.write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    # the list of copies is made from URLs and times; html is read where it is extracted
    text = plan(read_static(without_older_copies(stored)))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>\n", text + "\n")
    assert sum("html" in s for s in schemas) == 1 and len(schemas) == 3
    # three copies of c's neighbours with one time stay, one of each other URL
    assert without_older_copies(stored).count() == 2 + 100 + 1
