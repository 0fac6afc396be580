"""From a page to a product record: one narrow pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.inline import master_data_text, with_master_data, with_variants
from catalogspark.functions.jsonld import crumb_names, inner_crumbs, jsonld_entities, with_product_jsonld
from catalogspark.functions.markup import dom_enrichments, markup_candidate
from catalogspark.functions.text import is_blank, is_empty, nonblank, nonempty, pack_size, parse_price, strip, strip_all
from catalogspark.schemas import AVAILABILITIES, PRODUCT_SCHEMA, REQUIRED_FIELDS
from catalogspark.session import once

PARTIAL_FIELDS = (
    "sku",
    "name",
    "description",
    "brand",
    "price",
    "price_text",
    "currency",
    "availability",
    "image_urls",
    "product_url",
    "pack_size",
    "specifications",
    "alternative_products",
    "item_numbers",
    "mfr_numbers",
    "category_path",
)


_DOM_FIELDS = ("pack_size", "specifications", "alternative_products")
_MASTER_FIELDS = ("item_numbers", "mfr_numbers", "brand")
_ADDED = {*_DOM_FIELDS, *_MASTER_FIELDS, "category_path"}


def missing_fields(partial: Column) -> Column:
    """Required fields without a value, sorted; a price of 0 counts as none."""
    absent = {
        "name": is_blank(partial["name"]),
        "price": partial["price"].isNull() | (partial["price"] == 0),
        "sku": is_blank(partial["sku"]),
    }
    return F.array_compact(F.array(*[F.when(absent[f], F.lit(f)) for f in REQUIRED_FIELDS]))


def with_missing_fields(df: DataFrame, partial: str = "partial") -> DataFrame:
    """Add ``missing``, the required fields that the partial record lacks."""
    return df.withColumn("missing", missing_fields(F.col(partial)))


def missing_error(missing: Column, after_fallback: bool) -> Column:
    """Error text of an incomplete page."""
    when = "after" if after_fallback else "without"
    quoted = F.array_join(F.transform(missing, lambda f: F.concat(F.lit("'"), f, F.lit("'"))), ", ")
    return F.concat(F.lit(f"required fields missing {when} LLM fallback: ["), quoted, F.lit("]"))


def _read_blocks(pages: DataFrame) -> DataFrame:
    keys = [c for c in pages.columns if c != "html"]
    html = F.col("html")
    return pages.select(
        *keys,
        jsonld_entities(html).alias("_entities"),
        master_data_text(html).alias("_variants_text"),
        markup_candidate(html).alias("_markup"),
    )


def page_blocks(pages: DataFrame) -> DataFrame:
    """``pages`` with the parsed blocks of each page in place of ``html``.

    They are ``_entities`` (its JSON-LD), ``_variants_text`` (the literal with variant data) and ``_dom`` (the fields of its markup). Whoever
    stores them can extract again under other rules without the HTML. Pages without ``html`` have NULL blocks.
    """
    return _read_blocks(pages).withColumn("_dom", dom_enrichments(F.col("_markup"))).drop("_markup")


def extract_partial(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``partial`` (what the page says), ``method`` and ``missing``.

    JSON-LD comes first and markup adds to it. Variant data decides the brand and otherwise fills
    gaps, and the pack size may come from the description or the name. Pages without ``html`` get a
    partial record of NULLs. All other columns are kept.
    """
    return _partial(_read_blocks(pages), dom_enrichments(F.col("_markup")))


def partial_of_blocks(blocks: DataFrame) -> DataFrame:
    """``extract_partial`` from parsed blocks, as ``page_blocks`` gives them or as they were stored."""
    return _partial(blocks, F.col("_dom"))


def _partial(blocks: DataFrame, dom: Column) -> DataFrame:
    keys = [c for c in blocks.columns if c not in ("_entities", "_variants_text", "_markup", "_dom")]
    # Projections that several columns build on are kept apart by the optimizer, so the blocks of a
    # page are parsed once.
    facts = blocks.select("*", crumb_names(F.col("_entities")).alias("_crumbs"))
    # The variants come first: their steps would part the trips to Python of the product and of the markup.
    products = with_product_jsonld(with_master_data(facts, "_variants_text", "_master"), "_entities", "_fields")
    products = products.select(*keys, "_fields", "_master", dom.alias("_dom"), inner_crumbs(F.col("_crumbs")).alias("_path"))
    fields, dom, master = F.col("_fields"), F.col("_dom"), F.col("_master")
    merged = {name: fields[name] for name in PARTIAL_FIELDS if name not in _ADDED}
    merged |= {
        "brand": F.coalesce(master["brand"], fields["brand"]),
        "specifications": dom["specifications"],
        "alternative_products": dom["alternative_products"],
        "item_numbers": master["item_numbers"],
        "mfr_numbers": master["mfr_numbers"],
        "category_path": F.col("_path"),
        "pack_size": F.coalesce(dom["pack_size"], pack_size(fields["description"], fields["name"])),
    }
    found = fields.isNotNull()
    for part, names in ((dom, _DOM_FIELDS), (master, _MASTER_FIELDS)):
        for name in names:
            found = found | part[name].isNotNull()
    partial = F.struct(*[merged[name].alias(name) for name in PARTIAL_FIELDS])
    method = F.when(found, "json_ld").otherwise("dom")
    return with_missing_fields(once(products, keys, partial=partial, method=method))


def extract_variants(pages: DataFrame) -> DataFrame:
    """(url, place, position, item, mfr, brand) of each variant in the pages' inline data, in the order of the shop from place 0.

    A variant's blank or missing fields are NULL. Pages without variant data have no rows.
    """
    read = once(pages, ["url"], _text=master_data_text(F.col("html"))).where("_text <> ''")
    rows = with_variants(read, "_text", "_variants").select("url", F.posexplode("_variants").alias("place", "v"))
    return rows.select("url", "place", *[F.col(f"v.{name}").alias(name) for name in ("position", "item", "mfr", "brand")])


def merge_fallback(partial: Column, answer: Column, strict: bool = False) -> Column:
    """Partial record with its gaps filled from a fallback answer; values it has are kept.

    The path of the answer counts only if the page had no breadcrumbs. With ``strict`` an empty
    image list of a JSON-LD product stays empty, otherwise it is a gap like any other.
    """
    fills = {
        name: F.coalesce(nonblank(partial[name]), nonblank(answer[name]), partial[name])
        for name in ("sku", "name", "description", "brand", "currency", "availability", "pack_size")
    }
    fills |= {
        name: F.coalesce(nonempty(partial[name]), nonempty(_given(answer[name])), partial[name])
        for name in ("alternative_products", "item_numbers", "mfr_numbers", "category_path")
    }
    images = nonempty(F.filter(answer["image_urls"], lambda u: u.isNotNull()))
    known = partial["image_urls"] if strict else nonempty(partial["image_urls"])
    fills["image_urls"] = F.coalesce(known, images, partial["image_urls"])
    fills["specifications"] = F.coalesce(nonempty(partial["specifications"]), nonempty(answer["specifications"]))
    price = parse_price(answer["price"])
    fills["price"] = F.coalesce(partial["price"], price)
    fills["price_text"] = F.when(partial["price"].isNotNull(), partial["price_text"]).when(
        price.isNotNull(), strip(answer["price"])
    )
    fills["product_url"] = partial["product_url"]
    return F.struct(*[fills[name].alias(name) for name in PARTIAL_FIELDS])


def _given(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def product_record(
    partial: Column, url: Column, method: Column, source_category: Column, extracted_at: Column
) -> Column:
    """Product struct of a complete partial record: typed, stripped, with defaults."""
    no_list = F.array().cast("array<string>")
    availability = partial["availability"]
    allowed = availability.isNull() | availability.isin(*AVAILABILITIES)
    stripped = {
        name: strip(partial[name]) for name in ("sku", "name", "brand", "currency", "pack_size", "price_text")
    }
    lists = {
        name: strip_all(F.coalesce(partial[name], no_list))
        for name in ("item_numbers", "mfr_numbers", "category_path", "image_urls", "alternative_products")
    }
    specs = F.coalesce(partial["specifications"], F.create_map().cast("map<string,string>"))
    values = stripped | lists | {
        "product_url": strip(F.coalesce(nonblank(partial["product_url"]), url)),
        "price": partial["price"],
        "availability": F.when(allowed, availability).otherwise("Unknown"),
        "description": strip(F.coalesce(partial["description"], F.lit(""))),
        "specifications": _strip_entries(specs),
        "extracted_at": extracted_at,
        "extraction_method": method,
        "source_category": strip(source_category),
    }
    return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in PRODUCT_SCHEMA])


def _strip_entries(specs: Column) -> Column:
    """Strip names and values; of names that become equal the last value counts."""
    entries = F.transform(
        F.map_entries(specs), lambda e: F.struct(strip(e["key"]).alias("key"), strip(e["value"]).alias("value"))
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
        ),
    )
    return F.map_from_entries(last)


def build_records(extracted: DataFrame, extracted_at: Column, source_category: Column | None = None) -> DataFrame:
    """Products of the complete rows of ``extract_partial``; ``extracted_at`` is the run's time."""
    category = F.lit(None).cast("string") if source_category is None else source_category
    record = product_record(F.col("partial"), F.col("url"), F.col("method"), category, extracted_at)
    return extracted.where(is_empty(F.col("missing"))).select(record.alias("r")).select("r.*")
