"""The tiers of extraction as a stream: renderings and answers join the pages that wait for them, until it is too late."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from catalogspark.functions.text import is_blank
from catalogspark.plans.cascade import decide, read_static, route_outcomes
from catalogspark.plans.extraction import extract_partial
from catalogspark.sources.answers import parse_fallback_answers
from catalogspark.sources.store import KeyedTable
from catalogspark.streaming.incremental import writer_of


@dataclass(frozen=True)
class Waiting:
    """How long after its fetch a page waits for a rendering, how long after that for an answer, and how late rows may come; in event time."""

    rendering: str = "6 hours"
    answer: str = "1 day"
    late: str = "1 hour"


def _later(at: str, by: str) -> Column:
    return F.col(at) + F.expr(f"INTERVAL {by}")


def _timed(rows: DataFrame, at: str, late: str, wanted: Column) -> DataFrame:
    """The wanted rows that have a time; the others move the time on as well.

    A filter on other columns alone would be pushed below the watermark, which would then not see what it drops.
    """
    return rows.withWatermark(at, late).where(F.when(F.col(at).isNotNull(), wanted))


def stream_static(pages: DataFrame) -> DataFrame:
    """First tier of arriving pages, without state. Each tier is stored and is the next one's input, so nothing is extracted twice."""
    return read_static(pages)


def stream_rendering(static: DataFrame, rendered: DataFrame, waiting: Waiting = Waiting()) -> DataFrame:
    """Second tier: the open rows of the first, with ``r_partial`` and ``r_missing`` of a rendering, or NULLs if none came in time.

    ``static`` has fetched_at on every row, ``rendered`` (url, html, rendered_at). A rendering counts if it is dated within its time after the fetch. The
    outer join gives a row up once the watermark has passed its time; then the first tier decides, and the row's state goes.
    Several renderings give several rows.
    """
    opened = _timed(static, "fetched_at", waiting.late, F.col("fetch_error").isNull() & F.col("error").isNotNull())
    readable = _timed(rendered, "rendered_at", waiting.late, ~is_blank(F.col("html")))
    shown = extract_partial(readable.select("url", "html", "rendered_at"))
    shown = shown.select(F.col("url").alias("_url"), "rendered_at", F.col("partial").alias("r_partial"), F.col("missing").alias("r_missing"))
    in_time = (F.col("rendered_at") >= F.col("fetched_at")) & (F.col("rendered_at") <= _later("fetched_at", waiting.rendering))
    return opened.join(shown, (F.col("url") == F.col("_url")) & in_time, "left_outer").drop("_url")


def stream_answers(shown: DataFrame, answers: DataFrame, waiting: Waiting = Waiting(), strict: bool = False) -> DataFrame:
    """Outcomes of the stored second tier: at once for rows without or with a complete rendering; the others wait for an answer.

    ``answers`` has (url, content, answered_at). An answer counts if it is dated after the fetch and within its time after the rendering. Without one
    the page fails with what its rendering lacks. One join for each tier, with stored rows between them: joins in a row
    would lose rows of the first that time has passed already when they reach the second.
    """
    asked = F.coalesce(F.size("r_missing") > 0, F.lit(False))
    replies = parse_fallback_answers(answers.select(F.col("url").alias("_url"), "content", "answered_at"))
    nothing = shown.where(~asked).withColumns({c: F.lit(None).cast(replies.schema[c].dataType) for c in ("answered_at", "answer")})
    in_time = (F.col("answered_at") >= F.col("fetched_at")) & (F.col("answered_at") <= _later("rendered_at", waiting.answer))
    # follows from the others, and bounds how long an answer is kept
    in_time = in_time & (F.col("rendered_at") <= _later("answered_at", waiting.rendering))
    waits = _timed(shown, "rendered_at", waiting.late, asked)
    replies = replies.withWatermark("answered_at", waiting.late)
    joined = waits.join(replies, (F.col("url") == F.col("_url")) & in_time, "left_outer").drop("_url")
    return decide(joined, True, strict).unionByName(decide(nothing, True, strict))


def stream_outcomes(
    outcomes: DataFrame, products: KeyedTable, states: KeyedTable, at: Column, checkpoint: str, order: tuple[str, ...]
) -> StreamingQuery:
    """Upsert products and states from streamed outcomes until input runs out; ``order`` names the columns that order a micro-batch.

    Of several outcomes of a page the last counts, by micro-batch and then by ``order``, such as rendered_at and answered_at.
    """
    writer = writer_of(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            new_products, new_states = route_outcomes(batch, at, extra=order)
            products.write_batch(new_products, batch_id, list(order), writer)
            states.write_batch(new_states, batch_id, list(order), writer)
        finally:
            batch.unpersist()

    query = outcomes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()
