"""JSON-LD: from the script blocks of a page to product fields and a category path.

The shape of JSON-LD varies from page to page (an offer or a list of offers, a brand object or a
brand name), so blocks are parsed as VARIANT and each field is read by the type it turns out to have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalogspark.functions.text import (
    clean_description,
    nonblank,
    normalize_availability,
    parse_price,
    strip,
)
from catalogspark.session import once

# Fixed value: the script element that carries JSON-LD.
JSONLD_SCRIPT = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def _kind(v: Column) -> Column:
    """OBJECT<..>, ARRAY<..>, STRING, BIGINT, ...; NULL for an absent value."""
    return F.schema_of_variant(v)


def _is_object(v: Column) -> Column:
    return F.startswith(_kind(v), F.lit("OBJECT<"))


def _is_array(v: Column) -> Column:
    return F.startswith(_kind(v), F.lit("ARRAY<"))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    """Text of a string or number; NULL for an object or a list."""
    nested = F.regexp_like(_kind(v), F.lit("^(OBJECT|ARRAY)<"))
    return F.when(~nested, F.try_variant_get(v, "$", "string"))


def _string(v: Column) -> Column:
    """Text of a value that is a string, NULL for any other type."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _listed(text: Column) -> Column:
    # The parser stops after the first value. Inside brackets the rest is part of the value.
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def _only(listed: Column) -> Column:
    """The item of a list that has one."""
    return F.when(_at(listed, "$[1]").isNull(), _at(listed, "$[0]"))


def strict_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value; NULL if it is none or if anything follows it."""
    return _only(_listed(text))


def jsonld_blocks(html: Column) -> Column:
    """Every JSON-LD block that parses, in page order."""
    bodies = F.regexp_extract_all(html, F.lit(JSONLD_SCRIPT), F.lit(1))
    # in two passes, so that each body is parsed once
    return F.filter(F.transform(F.transform(bodies, _listed), _only), lambda v: v.isNotNull())


def flatten_jsonld(blocks: Column) -> Column:
    """Entities of the blocks: a list gives its items, an ``@graph`` its nodes; one level only."""

    def entities(block: Column) -> Column:
        graph = _at(block, '$["@graph"]')
        return (
            F.when(_is_array(block), _elements(block))
            .when(_is_array(graph), _elements(graph))
            .otherwise(F.array(block))
        )

    return F.filter(F.flatten(F.transform(blocks, entities)), _is_object)


def jsonld_entities(html: Column) -> Column:
    return flatten_jsonld(jsonld_blocks(html))


def first_of_type(entities: Column, type_name: str) -> Column:
    """First entity whose ``@type`` is exactly the given name, else NULL; a list of types never is."""
    return F.get(F.filter(entities, lambda e: F.try_variant_get(e, '$["@type"]', "string") == type_name), F.lit(0))


def _members(v: Column, *names: str) -> Column:
    """Struct of the named members of an object, each a VARIANT, read in one go."""
    return F.try_variant_get(v, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")


def product_members(entities: Column) -> Column:
    """Members of the first Product entity as they are, NULL when there is none."""
    product = first_of_type(entities, "Product")
    return _members(product, "sku", "name", "description", "brand", "image", "url", "offers")


def offer_members(offers: Column) -> Column:
    """Members of an offer, or of the first of a list of offers."""
    first = F.when(_is_array(offers), _at(offers, "$[0]")).otherwise(offers)
    return _members(first, "price", "priceCurrency", "availability")


def brand_name(brand: Column) -> Column:
    return F.when(_is_object(brand), _text(_at(brand, "$.name"))).otherwise(_string(brand))


def image_list(image: Column) -> Column:
    """Image addresses of a text, an object with ``url``, or a list of these; [] if there are none."""
    listed = F.when(_is_array(image), _elements(image)).when(image.isNotNull(), F.array(image))
    urls = F.transform(listed, lambda v: F.when(_is_object(v), _text(_at(v, "$.url"))).otherwise(_text(v)))
    return F.coalesce(F.filter(urls, lambda u: u != ""), F.array().cast("array<string>"))


def product_texts(product: Column, offer: Column) -> Column:
    """Product fields as the page writes them, as a struct; NULL when there is no product."""
    return F.when(
        product.isNotNull(),
        F.struct(
            nonblank(strip(_text(product["sku"]))).alias("sku"),
            nonblank(strip(_text(product["name"]))).alias("name"),
            strip(_text(product["description"])).alias("description"),
            brand_name(product["brand"]).alias("brand"),
            strip(_text(offer["price"])).alias("price"),
            _text(offer["priceCurrency"]).alias("currency"),
            normalize_availability(_text(offer["availability"])).alias("availability"),
            image_list(product["image"]).alias("image_urls"),
            _text(product["url"]).alias("product_url"),
        ),
    )


def with_product_jsonld(df: DataFrame, entities: str, product: str) -> DataFrame:
    """Replace the entities by a struct of the product's fields, NULL without a Product entity.

    Each step is a projection of its own, so that what several fields need is read once.
    """
    kept = [c for c in df.columns if c != entities]
    # not copied into filters on the product, which could go below a shuffle and read the page there as well
    members = once(df, kept, _members=product_members(F.col(entities)))
    offers = members.select(*kept, "_members", offer_members(F.col("_members.offers")).alias("_offer"))
    texts = offers.select(*kept, product_texts(F.col("_members"), F.col("_offer")).alias("_texts"))
    fields = product_fields(F.col("_texts"))
    typed = F.struct(*[c.alias(n) for n, c in fields.items()])
    return texts.select(*kept, F.when(F.col("_texts").isNotNull(), typed).alias(product))


def product_fields(texts: Column) -> dict[str, Column]:
    """The product fields of a ``product_texts`` struct: description cleaned, price typed."""
    price = parse_price(texts["price"])
    return {
        "sku": texts["sku"],
        "name": texts["name"],
        "description": clean_description(texts["description"]),
        "brand": texts["brand"],
        "price": price,
        "price_text": F.when(price.isNotNull(), texts["price"]),
        "currency": texts["currency"],
        "availability": texts["availability"],
        "image_urls": texts["image_urls"],
        "product_url": texts["product_url"],
    }


def sort_by_position(items: Column) -> Column:
    """Stable ascending sort of structs that have a ``position``; a missing position counts as 0."""
    numbered = F.transform(
        items,
        lambda item, i: F.struct(
            F.coalesce(item["position"], F.lit(0)).alias("position"), i.alias("index"), item.alias("item")
        ),
    )
    return F.transform(F.sort_array(numbered), lambda n: n["item"])


def crumb_names(entities: Column) -> Column:
    """Names of the first BreadcrumbList in their order, the start page and the product included."""
    crumbs = F.try_variant_get(
        first_of_type(entities, "BreadcrumbList"), "$.itemListElement", "array<struct<position:double,name:variant>>"
    )
    named = F.transform(
        F.filter(crumbs, lambda c: c.isNotNull()),
        lambda c: F.struct(c["position"].alias("position"), strip(_string(c["name"])).alias("name")),
    )
    return F.filter(F.transform(sort_by_position(named), lambda c: c["name"]), lambda n: n != "")


def inner_crumbs(names: Column) -> Column:
    """The category path: all names but the first and the last; [] for two or fewer."""
    path = F.when(F.size(names) > 2, F.slice(names, 2, F.size(names) - 2))
    return F.coalesce(path, F.array().cast("array<string>"))


def breadcrumb_path(entities: Column) -> Column:
    """Category names between the first crumb and the product itself; [] without any."""
    return inner_crumbs(crumb_names(entities))
