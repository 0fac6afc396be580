"""The tiers of extraction: cheap input first, costlier input only for what is still incomplete."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.text import is_blank, is_empty
from catalogspark.operators.ordering import first_seen, latest_by_key
from catalogspark.plans.extraction import extract_partial, merge_fallback, missing_error, missing_fields, product_record
from catalogspark.session import configure, materialize
from catalogspark.site import SiteConfig
from catalogspark.sources.answers import merge_parts, parse_fallback_answers
from catalogspark.sources.pages import build_fallback_requests
from catalogspark.sources.store import make_state

_TIER_COLUMNS = ("partial", "method", "missing", "error")


def read_static(pages: DataFrame) -> DataFrame:
    """First tier: ``extract_partial`` on fetched pages, with ``error`` for the incomplete ones."""
    read = extract_partial(pages)
    error = F.when(
        F.col("fetch_error").isNotNull(), F.concat(F.lit("static fetch: "), "fetch_error")
    ).when(F.size("missing") > 0, missing_error(F.col("missing"), after_fallback=False))
    return read.withColumn("error", error)


def join_tiers(
    incomplete: DataFrame, rendered: DataFrame | None = None, answers: DataFrame | None = None
) -> DataFrame:
    """Bring the costlier inputs to the rows that need them, as ``r_partial``, ``r_missing``, ``answer``.

    Only renderings of these rows are read. Of several renderings of a URL one is taken, and of several
    answers to the same part of it; the answers to its parts fill the gaps of those before. The joins merge them
    by URL, by which they are shuffled already; their estimated size is far too low to choose a broadcast by it.
    """
    if rendered is not None:
        wanted = rendered.where(~is_blank(F.col("html"))).join(incomplete.select("url"), "url", "left_semi")
        shown = extract_partial(with_copy_key(without_older_copies(wanted), "url", "html"))
        shown = latest_by_key(shown, "url", copy_order(shown))
        shown = shown.select("url", F.col("partial").alias("r_partial"), F.col("missing").alias("r_missing"))
        incomplete = incomplete.join(shown.hint("merge"), "url", "left")
    if answers is not None:
        if "part_no" in answers.columns:
            replies = first_seen(answers.select("url", "part_no", "content"), ["url", "part_no"], "content")
            parsed = merge_parts(parse_fallback_answers(replies))
        else:
            parsed = parse_fallback_answers(first_seen(answers.select("url", "content"), "url", "content"))
        incomplete = incomplete.join(parsed.hint("merge"), "url", "left")
    return incomplete


def without_older_copies(pages: DataFrame) -> DataFrame:
    """The pages but for copies that were fetched before the last of their URL, so that each page is extracted once.

    Only URLs and times are compared; a page's HTML is left where it is, unless the list of older copies is too long to broadcast.
    Copies with the same time all stay. A time that is not known is earlier than any other. Without ``fetched_at`` nothing is left out.
    """
    if "fetched_at" not in pages.columns:
        return pages
    times = pages.select("url", "fetched_at")
    last = times.groupBy("url").agg(
        F.max("fetched_at").alias("last"), F.min("fetched_at").alias("first"), F.count("fetched_at").alias("known"), F.count(F.lit(1)).alias("n")
    )
    several = last.where((F.col("first") < F.col("last")) | ((F.col("known") < F.col("n")) & (F.col("known") > 0))).select("url", "last")
    older = times.join(several, "url").where(F.col("fetched_at").isNull() | (F.col("fetched_at") < F.col("last")))
    older = older.select(F.col("url").alias("_url"), F.col("fetched_at").alias("_at")).distinct()
    same = (F.col("url") == F.col("_url")) & F.col("fetched_at").eqNullSafe(F.col("_at"))
    return pages.join(older, same, "left_anti")


def with_copy_key(pages: DataFrame, *columns: str) -> DataFrame:
    """The columns, the fetch time if there is one, and a key that tells copies of a page apart."""
    time = [c for c in ("fetched_at",) if c in pages.columns and c not in columns]
    return pages.select(*columns, *time, F.xxhash64("html").alias("copy_key"))


def copy_order(pages: DataFrame) -> list[str]:
    """The order in which the last copy of a page is the one to take."""
    return [c for c in ("fetched_at", "copy_key") if c in pages.columns]


def _filled(partial: Column, joined: DataFrame, strict: bool) -> Column:
    if "answer" not in joined.columns:
        return partial
    return F.when(F.col("answer").isNull(), partial).otherwise(merge_fallback(partial, F.col("answer"), strict))


def _after_fallback(rows: DataFrame, partial: Column, keys: list[str], strict: bool) -> DataFrame:
    merged = rows.withColumn("_merged", _filled(partial, rows, strict))
    missing = missing_fields(F.col("_merged"))
    return merged.select(
        *keys,
        F.col("_merged").alias("partial"),
        F.lit("llm_fallback").alias("method"),
        missing.alias("missing"),
        F.when(F.size(missing) > 0, missing_error(missing, after_fallback=True)).alias("error"),
    )


def union_tiers(*branches: DataFrame) -> DataFrame:
    """One row per URL from branches that share none."""
    whole, *rest = branches
    for branch in rest:
        whole = whole.unionByName(branch)
    return whole


def fallback_requests(
    static: DataFrame, pages: DataFrame, rendered: DataFrame | None = None, site: SiteConfig = SiteConfig()
) -> DataFrame:
    """What to ask a model: the pages that all cheaper tiers leave incomplete, as prompts.

    The page shown is the rendering, or without rendering the fetched page, of which the first tier is not
    repeated. Only incomplete pages are read.
    """
    incomplete = static.where(F.col("fetch_error").isNull() & F.col("error").isNotNull()).select("url", "missing")
    source = (pages if rendered is None else rendered).where(~is_blank(F.col("html")))
    source = with_copy_key(without_older_copies(source.join(incomplete.select("url"), "url", "left_semi")), "url", "html")
    source = latest_by_key(source, "url", copy_order(source)).select("url", "html")
    if rendered is None:
        return build_fallback_requests(source.join(incomplete, "url"), site)
    shown = extract_partial(source.withColumn("page", F.col("html"))).where(F.size("missing") > 0)
    return build_fallback_requests(shown.select("url", "missing", F.col("page").alias("html")), site)


def run_cascade(
    pages: DataFrame,
    rendered: DataFrame | None = None,
    answers: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    strict: bool = False,
    site: SiteConfig = SiteConfig(),
) -> DataFrame:
    """Outcome per page: the columns of ``pages`` without html, and partial, method, missing, error.

    A row without ``error`` is a success. With ``rendered`` given, an incomplete page counts by its
    rendering, and by an answer only if that is incomplete too; without a rendering it fails with the
    first tier's error. Without ``rendered``, answers apply to the fetched page. A failed fetch is
    final. ``answers`` is a table (url, content), with part_no if pages were asked about in parts, or a
    function that makes it from the requests.
    """
    configure(pages.sparkSession)
    static = materialize(read_static(pages), "static-tier")
    return resolve_tiers(static, rendered, given_answers(answers, static, pages, rendered, site), strict)


def given_answers(
    answers: DataFrame | Callable[[DataFrame], DataFrame] | None,
    static: DataFrame,
    pages: DataFrame,
    rendered: DataFrame | None,
    site: SiteConfig,
) -> DataFrame | None:
    """The table of answers; a function is asked once and its answers are stored, as each may cost money."""
    if not callable(answers):
        return answers
    return materialize(answers(fallback_requests(static, pages, rendered, site)), "answers")


def resolve_tiers(
    static: DataFrame,
    rendered: DataFrame | None = None,
    answers: DataFrame | None = None,
    strict: bool = False,
    store: bool = False,
) -> DataFrame:
    """``run_cascade`` on the stored first tier, which is read once per branch.

    With ``store`` the rows that went on to later tiers are stored too, for outcomes that several
    readers need; the settled ones already are.
    """
    settled, opened = split_tier(static)
    decided = decide(join_tiers(opened, rendered, answers), rendered is not None, strict)
    return union_tiers(settled, materialize(decided, "later-tiers") if store else decided)


def split_tier(static: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the first tier that are settled by it, and those that are open for later ones; both without a shuffle."""
    keys = [c for c in static.columns if c not in _TIER_COLUMNS]
    final = F.col("fetch_error").isNotNull() | F.col("error").isNull()
    return static.where(final).select(*keys, *_TIER_COLUMNS), static.where(~final)


def decide(joined: DataFrame, with_rendering: bool, strict: bool = False) -> DataFrame:
    """Outcomes of open rows with what the later tiers say: ``r_partial``, ``r_missing`` and ``answer`` of ``join_tiers``."""
    keys = [c for c in joined.columns if c not in (*_TIER_COLUMNS, "r_partial", "r_missing", "answer")]
    if not with_rendering:
        return _after_fallback(joined, F.col("partial"), keys, strict)
    # One pass over the joined rows decides all three cases, so the join runs once.
    has_rendering = F.col("r_partial").isNotNull()
    complete = has_rendering & is_empty(F.col("r_missing"))
    merged = joined.withColumn("_merged", _filled(F.col("r_partial"), joined, strict))
    still = missing_fields(F.col("_merged"))
    return merged.select(
        *keys,
        F.when(complete, F.col("r_partial")).when(has_rendering, F.col("_merged")).otherwise(F.col("partial")).alias("partial"),
        F.when(complete, "playwright_dom").when(has_rendering, "llm_fallback").otherwise(F.col("method")).alias("method"),
        F.when(complete, F.col("r_missing")).when(has_rendering, still).otherwise(F.col("missing")).alias("missing"),
        F.when(complete, None)
        .when(has_rendering, F.when(F.size(still) > 0, missing_error(still, after_fallback=True)))
        .otherwise(F.col("error"))
        .alias("error"),
    )


def route_outcomes(
    outcomes: DataFrame,
    at: Column,
    source_category: Column | None = None,
    failed_category: Column | None = None,
    extra: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Products of the successes, and the crawl state of every page: done or failed with its error.

    ``extra`` names outcome columns to keep on both, such as a sequence for the upserts.
    """
    category = F.col("category") if source_category is None else source_category
    failed_in = category if failed_category is None else failed_category
    done = F.col("error").isNull()
    record = product_record(F.col("partial"), F.col("url"), F.col("method"), category, at)
    products = outcomes.where(done).select(record.alias("r"), *extra).select("r.*", *extra)
    state = make_state(
        F.col("url"),
        F.when(done, category).otherwise(failed_in),
        F.when(done, "done").otherwise("failed"),
        F.when(done, record["sku"]),
        F.col("error"),
        at,
    )
    return products, outcomes.select(*state, *extra)
