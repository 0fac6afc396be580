"""Line deduplication by overlapping windows of three lines (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.llm.common import SPACE, packed
from catalogspark.session import once

WIDTH = 3


def _with_lines(df: DataFrame, keep: list[str], text: Column) -> DataFrame:
    """`lines` of a text, and `full`: the positions of those that have a word."""
    lined = once(df, keep, lines=F.split(text, "\n", -1))
    positions = F.transform("lines", lambda x, i: F.when(F.btrim(x, F.lit(SPACE)) != "", i))
    return once(lined, [*keep, "lines"], full=F.filter(positions, lambda i: i.isNotNull()))


def _identity(doc_id: Column, text: Column) -> list[Column]:
    """128 bits that name a document: its id and text."""
    return [F.xxhash64(doc_id, text).alias("id_a"), F.xxhash64(text, F.lit(1), doc_id).alias("id_b")]


def _windows(docs: DataFrame) -> DataFrame:
    """(id_a, id_b, doc_id, pos, a, b): a row per window, its position among the lines with a word and its 128-bit hash."""
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_identity(F.col("doc_id"), F.col("text")))
    lined = _with_lines(named, ["id_a", "id_b", "doc_id"], F.col("text"))
    starts = F.when(F.size("full") >= WIDTH, F.sequence(F.lit(0), F.size("full") - WIDTH))

    def key(i: Column) -> Column:
        parts = [F.get("lines", F.get("full", i + k)) for k in range(WIDTH)]
        return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("|"), *reversed(parts)).alias("b"))

    flat = lined.select("id_a", "id_b", "doc_id", F.posexplode(F.transform(starts, key)).alias("pos", "key"))
    return flat.select("id_a", "id_b", "doc_id", "pos", "key.a", "key.b")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(id_a, id_b, starts): per document the windows of which an equal one comes earlier, by doc_id and position.

    The first place of each window is found with partial sums before the shuffle. The join back has each window once on
    one side, so adaptive execution can split a hot one.
    """
    flat = _windows(docs)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "id_a", "id_b", "pos")
    first = flat.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = flat.join(first, ["a", "b"])
    same = (F.col("id_a") == F.col("first.id_a")) & (F.col("id_b") == F.col("first.id_b")) & (F.col("pos") == F.col("first.pos"))
    later = found.where(~same).select("id_a", "id_b", "pos").distinct()
    return later.groupBy("id_a", "id_b").agg(F.collect_list("pos").alias("starts"))


def dedup_lines(docs: DataFrame, *, count: str | None = "removed_lines") -> DataFrame:
    """`docs` with every column and row, the text without later occurrences of repeated windows, and how many lines went (int).

    `count` names the last column, which replaces one of that name; None leaves it out.

    A line ends at a line feed. A window is three consecutive lines that have a word; lines without one are passed over.
    The first occurrence of a window, by doc_id and position, stays. The lines that later ones cover go, overlaps merged,
    also within one document. Lines without a word stay. Windows are compared by 128 hashed bits of their exact lines.

    A NULL text stays NULL, and texts of fewer than three lines with a word stay as they are. Rows without doc_id come
    last, in the order of a hash. Rows with equal doc_id and text are one document and are treated alike. `n_chars`,
    if there, is not recomputed. Only positions are gathered, those of one document in one row, as its text is. An
    empty table gives an empty one.
    """
    doc_id, text = F.col("_row.doc_id"), F.coalesce("_row.text", F.lit(""))
    named = packed(docs).select("_row", *_identity(doc_id, text))
    joined = named.join(repeated_windows(docs), ["id_a", "id_b"], "left").select("_row", "starts")
    lined = _with_lines(joined, ["_row", "starts"], F.when(F.col("starts").isNotNull(), F.col("_row.text")))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.slice("full", s + 1, WIDTH))))
    lined = once(lined, ["_row", "lines"], covered=covered)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    lined = once(lined, ["_row", "lines", "covered"], left=F.when(F.col("covered").isNotNull(), left))
    kept = F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("covered").isNull(), F.col("_row.text")).otherwise(kept)
    columns = [text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != count]
    return lined.select(*columns, *([F.coalesce(F.size("covered"), F.lit(0)).alias(count)] if count else []))
