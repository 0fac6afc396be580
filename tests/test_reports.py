import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalogspark.operators.reports import (
    brand_mode,
    category_health,
    failure_buckets,
    method_rates,
    product_count,
    sample_for_review,
    status_counts,
    status_report,
)
from catalogspark.operators.rolling import rolling_mean, row_numbers


@pytest.fixture
def states(spark):
    rows = [("a", "x", "done", None), ("b", "x", "failed", "static fetch: HTTP 503"), ("c", "y", "failed", "read timed out"),
            ("d", "y", "failed", "required fields missing after LLM fallback: ['sku']"), ("e", "y", "failed", "unknown"), ("f", "y", "failed", None),
            ("g", "y", "failed", "static fetch: 404"), ("h", "z", "discovered", None)]
    return spark.createDataFrame(rows, "url string, category string, status string, error string")


@pytest.fixture
def products(spark):
    rows = [("1", "json_ld", "x")] * 17 + [("2", "llm_fallback", "x"), ("3", "playwright_dom", "y"), ("4", "json_ld", "y")]
    return spark.createDataFrame(rows, "sku string, extraction_method string, source_category string")


def test_counts(states, products):
    assert [tuple(r) for r in status_counts(states).collect()] == [("discovered", 1), ("done", 1), ("failed", 6)]
    assert product_count(products).first().n == 20
    assert {tuple(r) for r in status_report(products, states).collect()} == {
        ("products", "total", 20), ("crawl_state", "done", 1), ("crawl_state", "failed", 6), ("crawl_state", "discovered", 1)}


def test_failure_kinds(states):
    assert {r.kind: r.n for r in failure_buckets(states).collect()} == {"5xx": 1, "timeout": 1, "parse": 1, "fetch": 1, "other": 2}


def test_rates(products):
    row = method_rates(products).first()
    assert (row.json_ld_rate, row.llm_fallback_rate, row.low_json_ld, row.high_llm_fallback) == (0.9, 0.05, True, False)
    assert {r.source_category: r.playwright_dom_rate for r in method_rates(products, "source_category").collect()} == {"x": 0.0, "y": 0.5}


def test_health_against_a_baseline(spark, states, products):
    plain = {r.category: r for r in category_health(states, products).collect()}
    assert plain["x"].failure_rate == 0.5 and plain["z"].fallback_rate is None
    before = spark.createDataFrame([("x", 0.2, 0.05), ("y", 0.9, 0.0)], "category string, failure_rate double, fallback_rate double")
    rows = {r.category: (r.failure_spike, r.fallback_spike) for r in category_health(states, products, before).collect()}
    assert rows == {"x": (True, False), "y": (False, False), "z": (False, False)}


def test_brand_mode_ties_go_to_the_first(spark):
    rows = [(1, 0, "B"), (1, 1, "A"), (1, 2, " A "), (1, 3, "B"), (2, 0, " "), (2, 1, None), (3, 0, None), (3, 5, "C"), (3, 4, "D"), (3, 6, "C")]
    df = spark.createDataFrame(rows, "k int, pos int, maker string")
    assert {(r.k, r.brand, r.n) for r in brand_mode(df, "k", "maker", "pos").collect()} == {(1, "B", 2), (3, "C", 2)}


def test_sample_is_repeatable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("sku"))
    one, two = (sorted(r.sku for r in sample_for_review(d).collect()) for d in (df, df.repartition(5)))
    assert one == two and 350 < len(one) < 650


def test_rolling_mean_of_a_hot_group(spark):
    """A third of the rows in one group, chunks far smaller than the group, many equal times."""
    rows = [("hot" if i % 3 == 0 else f"g{i % 7}", (i * 37 % 1000) // 5, i, float(i % 11)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, at int, id int, v double").repartition(7)
    got = {r.id: r.rolling_mean for r in rolling_mean(df, ["g"], "at", ["id"], "v", 9, chunk_rows=25).collect()}
    groups = {}
    for g, at, i, v in rows:
        groups.setdefault(g, []).append((at, i, v))
    for members in groups.values():
        members.sort()
        for n, (_, i, _) in enumerate(members):
            window = [v for _, _, v in members[max(0, n - 9) : n + 1]]
            assert got[i] == pytest.approx(sum(window) / len(window))
    assert len(got) == 3000


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-5, 5)), min_size=1, max_size=60))
def test_row_numbers_match_a_full_sort(spark, rows):
    df = spark.createDataFrame([(g, at, i) for i, (g, at) in enumerate(rows)], "g int, at int, id int")
    got = {r.id: r.row_no for r in row_numbers(df, ["g"], "at", ["id"]).collect()}
    for g in {g for g, _ in rows}:
        order = sorted((at, i) for i, (h, at) in enumerate(rows) if h == g)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


def test_rolling_mean_keeps_missing_groups_and_splits_equal_times(spark):
    from catalogspark.operators.rolling import rolling_mean

    rows = [(None if i % 3 == 0 else "g", None if i % 10 == 0 else 7 if i % 2 else i, i, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, at int, no int, v double")
    got = {r.no: r.rolling_mean for r in rolling_mean(df, ["g"], "at", ["no"], "v", 2, chunk_rows=7).collect()}
    want = {}
    for group in (None, "g"):
        ordered = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for k, r in enumerate(ordered):
            near = [x[3] for x in ordered[max(0, k - 2) : k + 1]]
            want[r[2]] = sum(near) / len(near)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
