"""A corpus pipeline over `documents`: quality rules, line dedup, near-dedup, decontamination, piece encoding.

Each stage takes what its predecessor kept, and is written and read again, so that a lost executor costs a stage at most. All
but the last return the columns of `documents`. n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.llm import decontamination, line_dedup, near_dedup, pieces, quality_rules
from catalogspark.llm.common import table, unpacked
from catalogspark.llm.queries import PIECES
from catalogspark.session import configure, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    configure(spark)
    return unpacked(quality_rules.score_documents(docs, table(spark, sf_dir, "labels")).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of repeated three-line windows."""
    configure(spark)
    out = line_dedup.dedup_lines(docs, count=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id; rows without doc_id stay."""
    configure(spark)
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark item."""
    configure(spark)
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the ids of their pieces, their number, and whether decoding gives the text back."""
    configure(spark)
    return pieces.with_tokens(docs, PIECES)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]

#: SQL cannot state near-duplicate groups by hashed bands nor piece encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored below spark.checkpoint.dir but the last, which is read as it is made."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
