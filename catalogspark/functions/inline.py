"""Variant data that a page carries in an inline script variable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.jsonld import sort_by_position
from catalogspark.functions.text import nonblank, nonempty, strip
from catalogspark.session import once

# Fixed value: the assignment that carries the data, as a quoted JavaScript text. The possessive
# quantifiers keep Java's matcher from recursing once per character of a long text.
MASTER_DATA = r'window\.masterData\s*=\s*"((?:[^"\\]++|\\[^\n])*+)"'


def unescape_js(raw: Column) -> Column:
    """Text of a JavaScript string literal; characters outside ASCII stay as they are."""
    # JSON has no \xNN, so write it as \u00NN; an even run of backslashes before it is no escape.
    as_json = F.regexp_replace(raw, r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})", r"$1\\u00$2")
    lenient = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.get(F.from_json(F.concat(F.lit('["'), as_json, F.lit('"]')), "array<string>", lenient), F.lit(0))


def brand_mode(brands: Column) -> Column:
    """Most frequent value of an array; of equally frequent ones the first seen."""
    counted = F.transform(
        F.array_distinct(brands),
        lambda brand, i: F.struct(
            F.size(F.filter(brands, lambda b: b == brand)).alias("n"), (-i).alias("earlier"), brand.alias("brand")
        ),
    )
    return F.array_max(counted)["brand"]


def _last_values(entries: Column) -> Column:
    """Values of an object in the order of its keys; a repeated key has its last value in its first place."""
    keys, values = F.map_keys(entries), F.map_values(entries)
    last = F.transform(F.array_distinct(keys), lambda k: F.element_at(F.filter(values, lambda v, i: F.get(keys, i) == k), -1))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), values).otherwise(last)


def listed_objects(text: Column) -> Column:
    """The JSON value of a text as the items of a list, each a map; a text that is one object gives one."""
    # A map keeps the source order of keys, which a VARIANT would sort.
    # In brackets, because the parser would ignore what follows a whole object.
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,variant>>")


def variants_of(listed: Column) -> Column:
    """Variants of a JSON object of objects, by position and then by their order in the text; ``listed_objects`` reads it."""
    values = _last_values(F.when(F.size(listed) == 1, listed[0]))
    fields = "struct<position:variant,sku:variant,manufacturer_part_number:variant,manufacturer_name:variant>"
    objects = F.filter(
        F.transform(values, lambda v: F.try_variant_get(v, "$", fields)), lambda v: v.isNotNull()
    )

    def string(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", nonblank(strip(F.try_variant_get(v, "$", "string"))))

    return sort_by_position(
        F.transform(
            objects,
            lambda v: F.struct(
                F.when(
                    F.schema_of_variant(v["position"]) == "BIGINT", F.try_variant_get(v["position"], "$", "bigint")
                ).alias("position"),
                string(v["sku"]).alias("item"),
                string(v["manufacturer_part_number"]).alias("mfr"),
                string(v["manufacturer_name"]).alias("brand"),
            ),
        )
    )


def master_data_text(html: Column) -> Column:
    """The first literal with variant data, escaped as it stands; '' when there is none."""
    return F.regexp_extract(html, MASTER_DATA, 1)


def variant_lists(variants: Column) -> dict[str, Column]:
    """Item numbers, maker's numbers and brands of the variants, each without the blank ones."""

    def given(field: str) -> Column:
        return F.filter(F.transform(variants, lambda v: v[field]), lambda x: x.isNotNull())

    return {"item_numbers": given("item"), "mfr_numbers": given("mfr"), "brands": given("brand")}


def with_variants(df: DataFrame, text: str, into: str) -> DataFrame:
    """Replace the literal by its variants, one struct each, so that numbers stay aligned where one of them is blank.

    The literal and its JSON are parsed in steps of their own: the functions on arrays above them would parse again at each mention.
    """
    kept = [c for c in df.columns if c != text]
    plain = once(df, kept, _plain=unescape_js(nonblank(F.col(text))))
    listed = once(plain, kept, _listed=listed_objects(F.col("_plain")))
    return listed.select(*kept, variants_of(F.col("_listed")).alias(into))


def with_master_data(df: DataFrame, text: str, into: str) -> DataFrame:
    """Replace the literal by a struct of item_numbers, mfr_numbers and brand; NULL where nothing is given.

    Each step is a projection of its own, so that the literal is read once.
    """
    kept = [c for c in df.columns if c != text]
    variants = with_variants(df, text, "_variants")
    lists = variant_lists(F.col("_variants"))
    listed = variants.select(*kept, *[c.alias(f"_{n}") for n, c in lists.items()])
    data = F.struct(
        nonempty(F.col("_item_numbers")).alias("item_numbers"),
        nonempty(F.col("_mfr_numbers")).alias("mfr_numbers"),
        brand_mode(F.col("_brands")).alias("brand"),
    )
    return listed.select(*kept, data.alias(into))
