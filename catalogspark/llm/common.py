"""What the corpus operators share: columns of documents, words, and rows that keep every column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: space and the control characters from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The runs of non-space characters, in order; none for an empty text."""
    for c in SPACE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    # one character as separator is split without a regular expression
    return F.array_remove(F.split(text, " "), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def packed(docs: DataFrame) -> DataFrame:
    """Each row as one struct `_row`, so that no column of the caller can clash with a working column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")
