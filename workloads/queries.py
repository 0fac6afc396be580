"""One query per operator over the given tables, with the SQL that states its expected result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogspark.functions.inline import master_data_text, with_master_data
from catalogspark.functions.jsonld import breadcrumb_path, jsonld_entities, with_product_jsonld
from catalogspark.functions.markup import dom_enrichments, markup_candidate
from catalogspark.functions.ranking import completeness_of_product, dedupe_key, method_rank
from catalogspark.functions.text import clean_description, normalize_availability, pack_size, parse_price, strip
from catalogspark.plans import cascade, extraction
from catalogspark.session import bound_tasks, configure, new_dir
from catalogspark.sources import answers, export, pages, parsed
from workloads import inputs
from workloads.inputs import SITE, run_at, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BASE = SITE.base


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its oracle."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(bound_tasks(configure(spark)), sf_dir)

        QUERIES[build.__name__] = run
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def joined(c: Column) -> Column:
    """A list as text; an absent list as empty text."""
    return F.coalesce(F.array_join(c, "|"), F.lit(""))


def map_text(c: Column) -> Column:
    pairs = F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.coalesce(F.array_join(pairs, "|"), F.lit(""))


def partial_columns(partial: str = "partial") -> list[Column]:
    p = F.col(partial)
    plain = [p[n].alias(n) for n in ("sku", "name", "description", "brand", "price_text", "currency", "availability",
                                     "product_url", "pack_size")]
    lists = [joined(p[n]).alias(n) for n in ("image_urls", "alternative_products", "item_numbers", "mfr_numbers",
                                             "category_path")]
    return [*plain, map_text(p["specifications"]).alias("specifications"), *lists]


# --- expected extraction results, stated from the rows of part ----------------------------------

DESCRIPTION = """CASE p_partkey % 7 WHEN 0 THEN (p_size + 10) || ' gloves per box' WHEN 1 THEN (p_size + 10) || ' per case'
  WHEN 2 THEN 'Box of ' || (p_size + 10) WHEN 3 THEN 'Each bag contains ' || (p_size + 10)
  WHEN 4 THEN (p_size + 10) || ' ct/pack' WHEN 5 THEN 'Quantity: a few' ELSE 'Sold singly' END"""
GUESSED_PACK = """CASE p_partkey % 7 WHEN 0 THEN (p_size + 10) || '/box' WHEN 1 THEN (p_size + 10) || '/case'
  WHEN 2 THEN (p_size + 10) || '/box' WHEN 3 THEN (p_size + 10) || '/bag' WHEN 4 THEN (p_size + 10) || '/pack' END"""
PRICE = "printf('%.2f', p_retailprice)"


def expected(shape: str = "p_partkey % 8", fetched: bool = True) -> str:
    """SELECT of the partial record that a page of the given shape yields."""
    html = "(p_partkey % 97 <> 5)" if fetched else "true"
    return f"""
SELECT p_partkey, '{BASE}/product/p-' || p_partkey AS url, h AS has_html,
  CASE WHEN j THEN 'SKU-' || p_partkey END AS sku,
  CASE WHEN j THEN p_name END AS name,
  CASE WHEN j THEN CASE WHEN p_partkey % 3 = 0 THEN ({DESCRIPTION}) || ' ' || p_type ELSE {DESCRIPTION} END END AS description,
  CASE WHEN m THEN p_brand WHEN j THEN 'Seller' END AS brand,
  CASE WHEN j AND shape <> 4 THEN {PRICE} END AS price_text,
  CASE WHEN j THEN 'USD' END AS currency,
  CASE WHEN j THEN CASE p_size % 3 WHEN 0 THEN 'InStock' WHEN 1 THEN 'OutOfStock' ELSE 'Unknown' END END AS availability,
  CASE WHEN j THEN '{BASE}/product/p-' || p_partkey END AS product_url,
  CASE WHEN h AND grp = 1 THEN p_size || '/tray' WHEN j THEN {GUESSED_PACK} END AS pack_size,
  CASE WHEN h AND grp = 1 THEN 'Size=' || p_size || ' cm|Type=' || p_type ELSE '' END AS specifications,
  CASE WHEN j THEN 'https://img.example.com/' || p_partkey || '.jpg' ||
    CASE WHEN shape = 7 THEN '' ELSE '|https://img.example.com/' || p_partkey || '.jpg?v=2' END ELSE '' END AS image_urls,
  CASE WHEN h AND grp = 3 THEN '/product/p-' || p_partkey || '|/product/q-' || p_partkey ELSE '' END AS alternative_products,
  CASE WHEN m THEN p_partkey || '-1|' || p_partkey || '-2' ELSE '' END AS item_numbers,
  CASE WHEN m THEN 'M1-' || p_partkey || '|M2-' || p_partkey ELSE '' END AS mfr_numbers,
  CASE WHEN h THEN p_brand || '|' || p_type ELSE '' END AS category_path,
  CASE WHEN j OR m OR (h AND grp IN (1, 3)) THEN 'json_ld' ELSE 'dom' END AS method,
  CASE WHEN NOT j THEN 'name|price|sku' WHEN shape = 4 THEN 'price' ELSE '' END AS missing
FROM (SELECT *, h AND shape <> 5 AS j, h AND p_partkey % 5 <> 0 AS m
      FROM (SELECT *, {shape} AS shape, (p_partkey // 8) % 4 AS grp, {html} AS h FROM part))"""


STATIC = expected()
PARTIAL_NAMES = ("sku, name, description, brand, price_text, currency, availability, product_url, pack_size, specifications, "
                 "image_urls, alternative_products, item_numbers, mfr_numbers, category_path")


def static_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.product_pages(inputs.parts(spark, sf_dir))


# --- 2.8 column functions ----------------------------------------------------------------------


@query(f"""SELECT p_partkey AS position, sku, name, description,
  CASE WHEN sku IS NOT NULL THEN 'Seller' END AS brand, price_text, currency, availability, product_url, image_urls
FROM ({STATIC}) WHERE sku IS NOT NULL""")
def jsonld_product(spark, sf_dir):
    read = static_pages(spark, sf_dir).select("position", jsonld_entities(F.col("html")).alias("e"))
    found = with_product_jsonld(read, "e", "p").where("p IS NOT NULL")
    plain = ("sku", "name", "description", "brand", "price_text", "currency", "availability", "product_url")
    return found.select("position", *[f"p.{n}" for n in plain], joined(F.col("p.image_urls")).alias("image_urls"))


@query(f"SELECT p_partkey AS position, category_path FROM ({STATIC})")
def jsonld_breadcrumbs(spark, sf_dir):
    path = breadcrumb_path(jsonld_entities(F.col("html")))
    return static_pages(spark, sf_dir).select("position", joined(path).alias("category_path"))


@query(f"""SELECT p_partkey, {GUESSED_PACK} AS from_description, CASE WHEN p_partkey % 7 = 2 THEN (p_size + 10) || '/box'
  ELSE p_size || 9 || '/case' END AS from_name FROM part""")
def pack_size_wordings(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("description", inputs.part_description())
    other = F.when(F.col("p_partkey") % 7 == 2, F.col("description")).otherwise(F.lit("no size"))
    name = F.concat(F.lit("Kit, "), "p_size", F.lit("9 pieces / CASE"))
    return part.select(
        "p_partkey",
        pack_size(F.col("description")).alias("from_description"),
        pack_size(other, name).alias("from_name"),
    )


@query(f"""SELECT p_partkey AS position, item_numbers, mfr_numbers, p_brand AS brand
FROM ({STATIC}) JOIN (SELECT p_partkey, p_brand FROM part) USING (p_partkey) WHERE item_numbers <> ''""")
def inline_master_data(spark, sf_dir):
    read = static_pages(spark, sf_dir).select("position", master_data_text(F.col("html")).alias("raw"))
    data = with_master_data(read.where("raw <> ''"), "raw", "d")
    return data.select(
        "position",
        joined(F.col("d.item_numbers")).alias("item_numbers"),
        joined(F.col("d.mfr_numbers")).alias("mfr_numbers"),
        "d.brand",
    )


@query(f"""SELECT url, (k - 1)::INT AS place, k::BIGINT AS position, p_partkey || '-' || k AS item, 'M' || k || '-' || p_partkey AS mfr, p_brand AS brand
FROM ({STATIC}) JOIN (SELECT p_partkey, p_brand, unnest([1, 2]) AS k FROM part) USING (p_partkey) WHERE item_numbers <> ''""")
def product_variants(spark, sf_dir):
    return extraction.extract_variants(static_pages(spark, sf_dir).where("html IS NOT NULL"))


@query(f"""SELECT p_partkey AS position, CASE WHEN specifications <> '' THEN pack_size END AS pack_size,
  specifications, alternative_products FROM ({STATIC})""")
def markup_fields(spark, sf_dir):
    dom = dom_enrichments(markup_candidate(F.col("html")))
    return static_pages(spark, sf_dir).select("position", dom.alias("d")).select(
        "position",
        "d.pack_size",
        map_text(F.col("d.specifications")).alias("specifications"),
        joined(F.col("d.alternative_products")).alias("alternative_products"),
    )


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(text || ' & <ok> ' || source, '[ \\t]+', ' ', 'g'),
  '\\n{3,}', chr(10) || chr(10), 'g')) AS description FROM documents""")
def description_cleanup(spark, sf_dir):
    """Every document as a description whose markup was escaped twice, read back as plain text."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;amp;")), F.lit("<"), F.lit("&amp;lt;")), F.lit(">"), F.lit("&amp;gt;"))
    wrapped = F.concat(F.lit("&lt;p&gt;"), escaped, F.lit("&amp;nbsp;&amp;amp;&lt;br /&gt;&amp;lt;ok&amp;gt;&lt;i&gt;"), "source", F.lit("&lt;/i&gt;"))
    return table(spark, sf_dir, "documents").select("doc_id", clean_description(wrapped).alias("description"))


@query("""SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN printf('%.2f', o_totalprice) || '00000000' WHEN 2 THEN printf('%.2f', o_totalprice) || '00000000'
    WHEN 3 THEN NULL ELSE '1200.0000000000' END AS price,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'InStock' WHEN 2 THEN 'PreOrder' WHEN 3 THEN 'Unknown'
    ELSE 'Discontinued' END AS availability,
  o_orderpriority AS stripped FROM orders""")
def price_and_availability(spark, sf_dir):
    amount = F.format_string("%.2f", "o_totalprice")
    kind = F.col("o_orderkey") % 5
    price = (
        F.when(kind == 0, "").when(kind == 1, amount).when(kind == 2, F.concat(F.lit(" "), amount, F.lit(" ")))
        .when(kind == 3, F.concat(F.lit("1,"), amount)).otherwise("1.2e3")
    )
    stock = (
        F.when(kind == 0, "").when(kind == 1, "https://schema.org/InStock").when(kind == 2, "http://schema.org/PreOrder ")
        .when(kind == 3, "https://schema.org/SoldOut").otherwise("Discontinued")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        parse_price(price).cast("string").alias("price"),
        normalize_availability(stock).alias("availability"),
        strip(F.concat(F.lit(" \t"), "o_orderpriority", F.lit(" \r\n"))).alias("stripped"),
    )


OBS = f"""(SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_shipdate,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'json_ld' WHEN 'RF' THEN 'dom' WHEN 'NF' THEN 'playwright_dom'
    WHEN 'NO' THEN 'llm_fallback' ELSE 'other' END AS method,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 0 WHEN 'RF' THEN 1 WHEN 'NF' THEN 2 WHEN 'NO' THEN 3 ELSE 99 END AS method_rank,
  CAST(l_discount > 0.05 AS INT) + CAST(l_tax > 0.04 AS INT) + CAST(l_quantity > 25 AS INT)
    + CAST(CAST(l_quantity AS INT) % 2 = 0 AS INT) + CAST(l_linenumber > 4 AS INT) AS score
  FROM lineitem)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.observations(table(spark, sf_dir, "lineitem"))


@query(f"""SELECT l_orderkey, l_linenumber, l_suppkey, method_rank, CAST(score AS INT) AS completeness,
  CASE WHEN l_linenumber % 3 = 0 THEN '{BASE}/product/p-' || l_partkey ELSE '' || l_partkey END AS key FROM {OBS}""")
def ranking_functions(spark, sf_dir):
    blank = F.when(F.col("l_linenumber") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "sku"))
    return observations(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        method_rank(F.col("extraction_method")).alias("method_rank"),
        completeness_of_product().alias("completeness"),
        dedupe_key(blank, F.col("product_url")).alias("key"),
    )


# --- 2.9 extraction cascade ----------------------------------------------------------------------


@query(f"SELECT p_partkey AS position, {PARTIAL_NAMES}, method, missing FROM ({STATIC})")
def extract_partial(spark, sf_dir):
    read = extraction.extract_partial(static_pages(spark, sf_dir))
    return read.select("position", *partial_columns(), "method", joined(F.col("missing")).alias("missing"))


@query(f"SELECT p_partkey AS position, {PARTIAL_NAMES}, method, missing FROM ({STATIC})")
def extract_stored_blocks(spark, sf_dir):
    """Extraction from blocks that were parsed and stored before."""
    path = new_dir(spark, "blocks")
    parsed.store_blocks(static_pages(spark, sf_dir), path)
    read = extraction.partial_of_blocks(parsed.read_blocks(spark, path))
    return read.select("position", *partial_columns(), "method", joined(F.col("missing")).alias("missing"))


RECORD_NAMES = ("sku, item_numbers, mfr_numbers, name, product_url, category_path, brand, price_text, currency, availability, "
                "pack_size, description, specifications, image_urls, alternative_products")


def record_columns() -> list[Column]:
    lists = ("item_numbers", "mfr_numbers", "category_path", "image_urls", "alternative_products")
    plain = ("sku", "name", "product_url", "brand", "price_text", "currency", "availability", "pack_size", "description",
             "extraction_method", "source_category")
    return [
        *[F.col(n) for n in plain],
        *[joined(F.col(n)).alias(n) for n in lists],
        F.col("price").cast("string").alias("price"),
        map_text(F.col("specifications")).alias("specifications"),
        export.iso_time(F.col("extracted_at")).alias("extracted_at"),
    ]


@query(f"""SELECT {RECORD_NAMES}, price_text || '00000000' AS price, method AS extraction_method, p_type AS source_category,
  '2024-06-01T00:00:00+00:00' AS extracted_at
FROM ({STATIC}) JOIN (SELECT p_partkey, p_type FROM part) USING (p_partkey) WHERE missing = ''""")
def build_records(spark, sf_dir):
    read = extraction.extract_partial(static_pages(spark, sf_dir))
    return extraction.build_records(read, run_at(), F.col("category")).select(*record_columns())


ANSWERED = "(p_partkey % 8 IN (4, 5) AND p_partkey % 3 = 1)"
HAS_ANSWER = f"({ANSWERED} AND (p_partkey // 8) % 4 <> 3)"


@query(f"""SELECT '{BASE}/product/p-' || p_partkey AS url, CASE WHEN ok THEN 'A-' || p_partkey END AS sku,
  CASE WHEN ok THEN 'Answer ' || p_partkey END AS name, CASE WHEN ok THEN {PRICE} END AS price,
  CASE WHEN ok THEN 'https://img.example.com/a.jpg' ELSE '' END AS image_urls,
  CASE WHEN ok THEN 'Answers' ELSE '' END AS category_path
FROM (SELECT *, {HAS_ANSWER} AS ok FROM part WHERE {ANSWERED})""")
def fallback_answers(spark, sf_dir):
    parsed = answers.parse_fallback_answers(inputs.fallback_replies(table(spark, sf_dir, "part")))
    return parsed.select(
        "url",
        "answer.sku",
        "answer.name",
        "answer.price",
        joined(F.col("answer.image_urls")).alias("image_urls"),
        joined(F.col("answer.category_path")).alias("category_path"),
    )


def filled(sql: str) -> str:
    """The partial records of ``sql`` after their gaps were filled from the answers."""
    return f"""
SELECT p_partkey, url, CASE WHEN a THEN coalesce(sku, 'A-' || p_partkey) ELSE sku END AS sku,
  CASE WHEN a THEN coalesce(name, 'Answer ' || p_partkey) ELSE name END AS name, description, brand,
  CASE WHEN a THEN coalesce(price_text, price) ELSE price_text END AS price_text,
  CASE WHEN a THEN coalesce(currency, 'EUR') ELSE currency END AS currency, availability, product_url,
  CASE WHEN a THEN coalesce(pack_size, '5/kit') ELSE pack_size END AS pack_size, specifications,
  CASE WHEN a AND image_urls = '' THEN 'https://img.example.com/a.jpg' ELSE image_urls END AS image_urls,
  alternative_products, item_numbers, mfr_numbers,
  CASE WHEN a AND category_path = '' THEN 'Answers' ELSE category_path END AS category_path,
  CASE WHEN a THEN '' ELSE missing END AS missing, has_html
FROM ({sql}) JOIN (SELECT p_partkey, {HAS_ANSWER} AS a, {PRICE} AS price FROM part) USING (p_partkey)"""


@query(f"SELECT p_partkey AS position, {PARTIAL_NAMES}, missing FROM ({filled(STATIC)}) WHERE {ANSWERED}")
def merge_fallback(spark, sf_dir):
    part = inputs.parts(spark, sf_dir)
    read = extraction.extract_partial(inputs.product_pages(part))
    replies = answers.parse_fallback_answers(inputs.fallback_replies(part))
    # merged, as the records of all pages are too many for the broadcast that their estimated size would allow
    merged = read.hint("merge").join(replies, "url").withColumn(
        "partial", extraction.merge_fallback(F.col("partial"), F.col("answer"))
    )
    merged = extraction.with_missing_fields(merged)
    return merged.select("position", *partial_columns(), joined(F.col("missing")).alias("missing"))


def error_sql(missing: str, when: str) -> str:
    return f"'required fields missing {when} LLM fallback: [''' || replace({missing}, '|', ''', ''') || ''']'"


RENDERED = expected("CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 4 END", fetched=False)
_NAMES = [n.strip() for n in PARTIAL_NAMES.split(",")]
# A page that stays incomplete is judged by its rendering, if there is one, and then by an answer.
WITH_RENDERING = f"""
SELECT s.p_partkey, s.url, {', '.join(f'CASE WHEN tier = 0 THEN s.{n} WHEN tier = 1 THEN r.{n} ELSE f.{n} END AS {n}' for n in _NAMES)},
  CASE tier WHEN 0 THEN s.method WHEN 1 THEN 'playwright_dom' ELSE 'llm_fallback' END AS method,
  CASE tier WHEN 0 THEN s.missing WHEN 1 THEN '' ELSE f.missing END AS missing,
  CASE WHEN NOT s.has_html THEN 'static fetch: HTTP 503' WHEN tier = 1 OR s.missing = '' THEN NULL
    WHEN tier = 0 THEN {error_sql('s.missing', 'without')}
    WHEN f.missing <> '' THEN {error_sql('f.missing', 'after')} END AS error
FROM (SELECT *, CASE WHEN NOT has_html OR missing = '' OR p_partkey % 3 = 2 THEN 0 WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS tier
      FROM ({STATIC})) s
JOIN ({RENDERED}) r USING (p_partkey) JOIN ({filled(RENDERED)}) f USING (p_partkey)"""


def cascade_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = inputs.parts(spark, sf_dir)
    return cascade.run_cascade(
        inputs.product_pages(part), inputs.rendered_pages(part), inputs.fallback_replies(part)
    )


@query(f"SELECT p_partkey AS position, {PARTIAL_NAMES}, method, missing, error FROM ({WITH_RENDERING})")
def cascade_with_rendering(spark, sf_dir):
    outcomes = cascade_outcomes(spark, sf_dir)
    return outcomes.select("position", *partial_columns(), "method", joined(F.col("missing")).alias("missing"), "error")


@query(f"""SELECT p_partkey AS position, f.sku, f.name, f.price_text,
  CASE WHEN s.has_html AND s.missing <> '' THEN 'llm_fallback' ELSE s.method END AS method,
  CASE WHEN NOT s.has_html THEN 'static fetch: HTTP 503' WHEN s.missing = '' OR f.missing = '' THEN NULL
    ELSE {error_sql('f.missing', 'after')} END AS error
FROM ({STATIC}) s JOIN (SELECT p_partkey, has_html, CASE WHEN has_html THEN sku END AS sku, CASE WHEN has_html THEN name END AS name,
  CASE WHEN has_html THEN price_text END AS price_text, missing FROM ({filled(STATIC)})) f USING (p_partkey)""")
def cascade_without_rendering(spark, sf_dir):
    part = inputs.parts(spark, sf_dir)
    outcomes = cascade.run_cascade(inputs.product_pages(part), answers=inputs.fallback_replies(part))
    return outcomes.select("position", "partial.sku", "partial.name", "partial.price_text", "method", "error")


@query(f"""SELECT {RECORD_NAMES.replace('price_text, ', '').replace('product_url', "coalesce(product_url, url) AS product_url").replace('description', "coalesce(description, '') AS description")}, price_text, price_text || '00000000' AS price,
  method AS extraction_method, p_type AS source_category, '2024-06-01T00:00:00+00:00' AS extracted_at
FROM ({WITH_RENDERING}) JOIN (SELECT p_partkey, p_type FROM part) USING (p_partkey) WHERE error IS NULL""")
def outcome_products(spark, sf_dir):
    products, _ = cascade.route_outcomes(cascade_outcomes(spark, sf_dir), run_at())
    return products.select(*record_columns())


@query(f"""SELECT url, p_type AS category, CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END AS status,
  CASE WHEN error IS NULL THEN sku END AS sku, error, '2024-06-01T00:00:00+00:00' AS updated_at
FROM ({WITH_RENDERING}) JOIN (SELECT p_partkey, p_type FROM part) USING (p_partkey)""")
def outcome_states(spark, sf_dir):
    _, states = cascade.route_outcomes(cascade_outcomes(spark, sf_dir), run_at())
    return states.withColumn("updated_at", export.iso_time(F.col("updated_at")))


@query(f"""SELECT url, replace(missing, '|', ', ') AS missing, true AS whole FROM ({STATIC})
WHERE has_html AND missing <> ''""")
def fallback_requests(spark, sf_dir):
    incomplete = static_pages(spark, sf_dir).where("html IS NOT NULL")
    read = extraction.extract_partial(incomplete.withColumn("page", F.col("html"))).withColumnRenamed("page", "html")
    asked = pages.build_fallback_requests(read, replace(SITE, fallback_html_chars=300))
    # the pages put together again from the parts of their prompts, after the heading
    shown = F.regexp_extract("prompt", r"(?s)^Page: [^\n]*\nFill in: [^\n]*\nHTML, part \d+ of \d+:\n(.*)$", 1)
    parts = F.array_sort(F.collect_list(F.struct("part_no", shown.alias("shown"))))
    again = asked.groupBy("url", "missing").agg(F.array_join(F.transform(parts, lambda p: p["shown"]), "").alias("html"), F.max("parts").alias("parts"))
    joined = again.join(incomplete.select("url", F.col("html").alias("page")), "url")
    whole = (F.col("html") == F.col("page")) & (F.col("parts") == F.ceil(F.length("page") / 300))
    return joined.select("url", F.array_join("missing", ", ").alias("missing"), whole.alias("whole"))


@query("""SELECT doc_id, greatest(ceil((2 * length(text) + length('[fact of ' || doc_id || ']') - 60) / 340), 1)::INT AS parts, true AS whole
FROM documents WHERE text <> ''""")
def overlapping_prompts(spark, sf_dir):
    """A fact in the middle of each text, and whether a prompt shows it whole."""
    site = replace(SITE, fallback_html_chars=400, fallback_overlap_chars=60)
    fact = F.concat(F.lit("[fact of "), "doc_id", F.lit("]"))
    texts = table(spark, sf_dir, "documents").where("text <> ''")
    asked = texts.select(F.col("doc_id").cast("string").alias("url"), F.array(F.lit("price")).alias("missing"), F.concat("text", fact, "text").alias("html"))
    shown = pages.build_fallback_requests(asked, site).groupBy(F.col("url").cast("long").alias("doc_id"))
    whole = F.max(F.contains("prompt", F.concat(F.lit("[fact of "), "url", F.lit("]")))).alias("whole")
    return shown.agg(F.max("parts").alias("parts"), whole)


@query(f"""SELECT '{BASE}/product/p-' || p_partkey AS url, 'static fetch: HTTP 503' AS error FROM part
WHERE p_partkey % 97 = 5""")
def page_table_failures(spark, sf_dir):
    """The pages as a stored table, read with its schema; its failed fetches."""
    path = new_dir(spark, "pages")
    fetched = static_pages(spark, sf_dir).withColumn("fetched_at", run_at())
    fetched.write.parquet(path)
    return pages.fetch_failures(pages.read_pages(spark, path))
