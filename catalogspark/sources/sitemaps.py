"""Sitemaps: the addresses a shop announces, with the time of their last change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.text import nonblank, strip

ENTRY = "loc string, lastmod string"


def last_change(text: Column) -> Column:
    """A W3C date or time as a timestamp: a year, month, day, or a time with zone. A time without zone is UTC, other text NULL."""
    value = strip(text)
    # a zone Z and times without seconds, which a cast does not read
    whole = F.regexp_replace(value, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})?$", "$1:00$2")
    shaped = F.rlike(whole, F.lit(r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"))
    return F.when(shaped, whole.try_cast("timestamp"))


def read_sitemaps(spark: SparkSession, path: str, entry: str = "url") -> DataFrame:
    """(url, lastmod, corrupt) of sitemap files below ``path``, plain or gzipped; each entry is a row, so no file is held whole.

    ``entry="sitemap"`` reads index files instead, whose rows name further sitemaps. ``corrupt`` holds the text of an
    entry that is no XML, with NULL for the other columns. An entry without address is left out.
    """
    reader = spark.read.format("xml").options(rowTag=entry, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")
    rows = reader.schema(f"{ENTRY}, corrupt string").load(path)
    entries = rows.select(nonblank(strip(F.col("loc"))).alias("url"), last_change(F.col("lastmod")).alias("lastmod"), "corrupt")
    return entries.where("url IS NOT NULL OR corrupt IS NOT NULL")


def parse_sitemaps(fetched: DataFrame) -> DataFrame:
    """(sitemap, kind, url, lastmod) of fetched sitemaps (url, body), one row per entry.

    ``kind`` is ``url``, or ``sitemap`` for an entry of an index, to be fetched next. A body that is NULL or no XML gives
    one row of kind ``corrupt``. A sitemap has at most 50,000 entries by its protocol.
    """
    shape = f"url array<struct<{ENTRY}>>, sitemap array<struct<{ENTRY}>>, corrupt string"
    read = F.from_xml("body", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    parsed = fetched.select(F.col("url").alias("sitemap"), "body", read.alias("read"))

    def entries(kind: str) -> Column:
        given = F.coalesce(F.col(f"read.{kind}"), F.array().cast(f"array<struct<{ENTRY}>>"))
        return F.transform(given, lambda e: F.struct(F.lit(kind).alias("kind"), nonblank(strip(e["loc"])).alias("url"), e["lastmod"].alias("lastmod")))

    broken = F.array(F.struct(F.lit("corrupt").alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("lastmod")))
    bad = F.col("body").isNull() | F.col("read.corrupt").isNotNull()
    listed = F.filter(F.concat(entries("url"), entries("sitemap")), lambda e: e["url"].isNotNull())
    rows = parsed.select("sitemap", F.explode(F.when(bad, broken).otherwise(listed)).alias("e"))
    return rows.select("sitemap", "e.kind", "e.url", last_change(F.col("e.lastmod")).alias("lastmod"))


def listed_changes(entries: DataFrame) -> DataFrame:
    """(url, lastmod): the last change that any sitemap gives for an address, as ``refresh_frontier`` reads it."""
    return entries.where("url IS NOT NULL").groupBy("url").agg(F.max("lastmod").alias("lastmod"))
