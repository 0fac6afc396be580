"""Categories ranked by how well their names and product titles fit an intent in words.

The words of a category and of the titles in it are cut into runs of three characters, so inflected and misspelt words still
meet. A category's score is its BM25 over these runs. Only runs that the intent has are counted, before the first shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.operators.discovery import words_of
from catalogspark.session import materialize

GRAM = 3


def grams(text: Column) -> Column:
    """Runs of three characters of each word, with a space at both ends of the word; as many as the word has characters."""
    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(GRAM)))

    return F.flatten(F.transform(words_of(text), of_word))


def intent_scores(categories: DataFrame, titles: DataFrame, intent: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(slug, score) of the categories that share a run with the intent.

    Needs categories (name, slug) and titles (slug, title); a title whose slug is no category counts for a category of that slug.
    NULL texts have no runs and rows without slug are left out. Repeated titles count as often as they occur.
    """
    wanted = F.array_distinct(grams(F.lit(intent)))
    named = categories.select("slug", F.concat_ws(" ", "name", "slug").alias("text"))
    texts = named.unionByName(titles.select("slug", F.col("title").alias("text"))).where("slug IS NOT NULL")
    cut = texts.select("slug", F.coalesce(grams(F.col("text")), F.array().cast("array<string>")).alias("grams"))
    # one pass: the runs that the intent has, and the length of all of them
    met = F.transform(F.filter("grams", lambda g: F.array_contains(wanted, g)), lambda g: F.struct(g.alias("gram"), F.lit(1).alias("n"), F.lit(0).alias("length")))
    size = F.array(F.struct(F.lit(None).cast("string").alias("gram"), F.lit(0).alias("n"), F.size("grams").alias("length")))
    counted = cut.select("slug", F.explode(F.concat(met, size)).alias("e")).groupBy("slug", F.col("e.gram").alias("gram"))
    counted = materialize(counted.agg(F.sum("e.n").alias("n"), F.sum("e.length").alias("length")), "grams")

    lengths = counted.where("gram IS NULL").select("slug", "length")
    whole = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("length")).first()
    postings = counted.where("gram IS NOT NULL").select("slug", "gram", "n")
    holders = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("holders"))
    weight = F.log1p((F.lit(whole.n) - F.col("holders") + 0.5) / (F.col("holders") + 0.5))
    norm = F.lit(1 - b) + F.lit(b) * F.col("length") / F.lit(whole.length or 1.0)
    share = F.col("n") * (k1 + 1) / (F.col("n") + F.lit(k1) * norm)
    return postings.join(holders, "gram").join(lengths, "slug").groupBy("slug").agg(F.sum(weight * share).alias("score"))


def rank_by_intent(categories: DataFrame, titles: DataFrame, intent: str | None, least: float = 0.3) -> DataFrame:
    """Categories with ``score``, those whose score is at least ``least`` of the best one's; with a blank intent all, without score.

    A low ``least`` includes when in doubt. An intent that shares no run with any category selects none.
    """
    if intent is None or not intent.strip():
        return categories.withColumn("score", F.lit(None).cast("double"))
    scores = materialize(intent_scores(categories, titles, intent), "scores")
    best = scores.agg(F.max("score").alias("best")).first().best
    return categories.join(scores.where(F.col("score") >= F.lit(least) * F.lit(best or 0.0)), "slug")
