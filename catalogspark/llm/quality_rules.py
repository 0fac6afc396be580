"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio between two corpora (native)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm.common import SPACE, ascii_lower, packed, text_or_empty, words
from catalogspark.session import once

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Parameters."""

    buckets: int = 1 << 16
    shrink: float = 8.0
    min_words: int = 50
    max_repeat_percent: int = 50
    threshold: float = -0.03


def _covered(places: str) -> Column:
    """Words that three-word windows at the sorted positions cover, overlaps counted once."""
    p = F.col(places)
    steps = F.transform(places, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def with_counts(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """`keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), and the hashes `folded` of the words in lower case.

    Repeated windows compare the words as they are written. Windows that repeat do so in lower case as well, so the words as written are
    hashed only where windows in lower case repeat.
    """
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = once(df, [*keep, text], folded_words=words(_folded(text)), lines=lines)
    hashes = F.transform("folded_words", lambda x: F.xxhash64(x))
    n_chars = F.length(F.array_join("folded_words", ""))
    df = once(df, [*keep, text, "lines"], folded=hashes, word_chars=n_chars.cast("long"))
    counts = dict(
        n_words=F.size("folded").cast("long"),
        n_symbols=F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    )
    df = once(df, [*keep, "folded", "word_chars", text], **counts, threes=_windows("folded"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    repeats = lambda: F.size(F.array_distinct("threes")) < F.size("threes")
    df = once(df, [*keep, "folded", *counts], w=F.when(repeats(), _word_hashes(F.col(text))))
    df = once(df, [*keep, "folded", *counts], threes=_windows("w"))
    # equal windows stand side by side once sorted; only texts with any are sorted
    pairs = F.when(repeats(), F.sort_array(F.transform("threes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = once(df, [*keep, "folded", *counts], pairs=pairs)
    hash_at = lambda i: F.get("pairs", i)["h"]
    again = lambda x, i: F.when((x["h"] == hash_at(i + 1)) | ((i > 0) & (x["h"] == hash_at(F.greatest(i - 1, F.lit(0))))), x["i"])
    places = F.sort_array(F.filter(F.transform("pairs", again), lambda i: i.isNotNull()))
    df = once(df, [*keep, "folded", *counts], places=places)
    return df.select(*keep, "folded", *counts, F.coalesce(_covered("places"), F.lit(0)).cast("long").alias("n_repeat_words"))


def _windows(hashes: str) -> Column:
    """Hashes of three neighbouring words, in order; none if there are fewer or the words are not given."""
    at = lambda i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2))
    some = F.transform(F.sequence(F.lit(0), F.size(hashes) - 3), at)
    return F.when(F.coalesce(F.size(hashes), F.lit(0)) >= 3, some).otherwise(F.array().cast("array<bigint>"))


def _folded(text: str) -> Column:
    """A-Z in lower case; a text that is ASCII as a whole takes the built-in way."""
    is_ascii = F.octet_length(text) == F.length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(ascii_lower(F.col(text)))


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda x: F.xxhash64(x))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def _pair(w: str, i: Column) -> Column:
    """The hash of a word, by its place from the second on, and the one before."""
    return F.xxhash64(F.get(w, F.greatest(i - 1, F.lit(0))), F.get(w, i))


def _bucket_counts(docs: DataFrame, buckets: int) -> dict[int, int]:
    """How many words, and pairs of neighbours, fall into each bucket. Words meet the next one in rows, so that hashing them is compiled."""
    split = once(docs.select(text_or_empty().alias("text")), [], w=words(_folded("text")))
    following = F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))
    rows = split.select(F.explode(F.arrays_zip(F.col("w").alias("word"), following.alias("next"))).alias("z"))
    pair = F.when(F.col("z.next").isNotNull(), _bucket(F.xxhash64(F.xxhash64("z.word"), F.xxhash64("z.next")), buckets))
    both = rows.select(F.explode(F.array(_bucket(F.xxhash64("z.word"), buckets), pair)).alias("bucket")).where("bucket IS NOT NULL")
    return {row["bucket"]: row["n"] for row in both.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}


@contextmanager
def _early_filter(spark: SparkSession) -> Iterator[None]:
    """Let Spark drop rows in the scan by a bloom filter of the other side's keys, of 1 MB, before a join shuffles them.

    It does so by itself only for tables of 10 GB and more.
    """
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "0")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def log_ratios(docs: DataFrame, labels: DataFrame, rules: Rules) -> list[float]:
    """Per bucket log(p_target / p_raw), drawn towards 0 by `shrink` n-grams of the raw corpus so that rare buckets say little.

    The raw corpus is all of `docs`, the target all documents labelled quality 1 and toxic 0. Where labels are too many to broadcast, the
    texts of the target are shuffled to meet them, and few others. The vector has one entry per bucket, however large the corpus.
    """
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id")
    raw = _bucket_counts(docs, rules.buckets)
    with _early_filter(docs.sparkSession):
        target = _bucket_counts(docs.select("doc_id", "text").join(trusted, "doc_id", "left_semi"), rules.buckets)
    share = sum(target.values()) / max(1, sum(raw.values()))
    ratio = lambda b: math.log((target.get(b, 0) + rules.shrink) / (share * raw[b] + rules.shrink))
    return [round(ratio(b), 4) if b in raw else 0.0 for b in range(rules.buckets)]


def llr(w: str, ratios: list[float]) -> Column:
    """The mean log ratio of a text's words and pairs of neighbours; NULL without words. The ratios become one constant array of the plan."""
    weights = F.split(F.lit(" ".join(f"{x:g}" for x in ratios)), " ").cast("array<double>")
    weight = lambda h: F.get(weights, _bucket(h, len(ratios)))
    each = F.transform(w, lambda h, i: weight(h) + F.when(i > 0, weight(_pair(w, i))).otherwise(F.lit(0.0)))
    total = F.aggregate(each, F.lit(0.0), lambda sum_, x: sum_ + x)
    return total / F.nullif(2 * F.size(w) - 1, F.lit(-1))


def score_documents(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`docs` as `_row`, with the counts, base_failed, llr (double) and kept.

    base_failed: fewer than `min_words` words, or more than `max_repeat_percent` % of the words in repeated three-word windows.
    kept: not base_failed, and llr at or above `threshold`. Every document gets a verdict, always the same for the same tables.

    A NULL or blank text has no words and fails. Repeated rows are judged each by itself; those with equal ids all
    count. Without trusted labels the ratios are near zero and the counts alone decide. Labels with NULLs are not trusted. An
    empty table gives an empty one. Rows keep all columns, in `_row`.
    """
    ratios = log_ratios(docs, labels, rules)
    rows = packed(docs).select("_row", F.coalesce("_row.text", F.lit("")).alias("text"))
    counted = with_counts(rows, ["_row"], "text")
    scored = once(counted, [c for c in counted.columns if c != "folded"], llr=llr("folded", ratios))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= rules.threshold, F.lit(False)))

