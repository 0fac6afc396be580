"""Replies of a model to fallback requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from catalogspark.functions.jsonld import strict_json
from catalogspark.functions.text import nonblank, nonempty, parse_price, strip
from catalogspark.schemas import ANSWER_SCHEMA


def reply_json(content: Column) -> Column:
    """The JSON text of a reply, without a code fence and its language tag."""
    text = strip(content)
    inner = F.btrim(text, F.lit("`"))
    unfenced = strip(F.regexp_replace(inner, r"(?i)^json", ""))
    return F.when(F.startswith(text, F.lit("```")), unfenced).otherwise(text)


def _given(field: StructField) -> Column:
    """A field of an answer if it says anything."""
    value = F.col("answer")[field.name]
    if field.name == "price":
        return F.when(parse_price(value).isNotNull(), value)
    if field.dataType == StringType():
        return nonblank(value)
    return nonempty(value)


def merge_parts(answers: DataFrame) -> DataFrame:
    """(url, answer) from (url, part_no, answer): each field from the first part that gives it."""
    fields = [F.min_by(_given(f), F.when(_given(f).isNotNull(), F.col("part_no"))).alias(f.name) for f in ANSWER_SCHEMA]
    merged = answers.groupBy("url").agg(*fields)
    return merged.select("url", F.struct(*[f.name for f in ANSWER_SCHEMA]).alias("answer"))


def parse_fallback_answers(replies: DataFrame) -> DataFrame:
    """Add ``answer``; a reply that is no JSON object gives a struct of NULLs."""
    text = reply_json(F.col("content"))
    is_object = F.startswith(F.schema_of_variant(strict_json(text)), F.lit("OBJECT<"))
    nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in ANSWER_SCHEMA])
    answer = F.when(is_object, F.from_json(text, ANSWER_SCHEMA))
    return replies.withColumn("answer", F.coalesce(answer, nothing)).drop("content")
