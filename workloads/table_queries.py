"""Queries of the operators on links, listings, records, states and reports."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from catalogspark.operators import alternatives, backpressure, constraints, dedupe, discovery, frontier, intent, ordering, reports, review
from catalogspark.plans import cascade, catalog_job
from catalogspark.schemas import PRODUCT_SCHEMA, STATE_SCHEMA
from catalogspark.session import materialize, new_dir
from catalogspark.sources import export, layout, listings, pages, recs, sitemaps, store
from catalogspark.streaming import cascade as streamed
from catalogspark.streaming import incremental
from workloads import inputs
from workloads.inputs import SEEN, SITE, run_at, table
from workloads.queries import BASE, OBS, STATIC, WITH_RENDERING, joined, observations, query

SEEN_SQL = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice"

# --- 2.2 links and filters -----------------------------------------------------------------------

CATEGORY_LINK = f"""CASE s_suppkey % 5 WHEN 0 THEN '{BASE}/catalog/s-' || s_suppkey WHEN 1 THEN '{BASE}/catalog/s-' || s_suppkey
  WHEN 2 THEN 'HTTPS://www.shop.example.com/catalog/s-' || s_suppkey
  WHEN 4 THEN CASE WHEN s_suppkey % 2 = 1 THEN '{BASE}/catalog/shared' END END"""


@query(f"""SELECT CASE WHEN s_suppkey % 3 = 0 THEN slug ELSE s_name END AS name, url, slug, s_suppkey AS position
FROM (SELECT *, regexp_extract(url, '[^/]+$') AS slug, row_number() OVER (PARTITION BY url ORDER BY s_suppkey) AS rn
      FROM (SELECT *, {CATEGORY_LINK} AS url FROM supplier) WHERE url IS NOT NULL) WHERE rn = 1""")
def canonical_categories(spark, sf_dir):
    found = discovery.canonical_categories(inputs.categories(table(spark, sf_dir, "supplier")), SITE)
    return found.select("name", "url", "slug", "position")


@query(f"""SELECT 's-' || l_suppkey AS category, '{BASE}/product/p-' || l_partkey AS url, l_orderkey, l_linenumber FROM
(SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY {SEEN_SQL}) AS rn FROM lineitem WHERE l_linenumber % 4 <> 3)
WHERE rn = 1""")
def canonical_product_urls(spark, sf_dir):
    hits = inputs.listing_hits(table(spark, sf_dir, "lineitem"))
    first = discovery.canonical_product_urls(hits, SITE, keys=("category", "url"), order=SEEN)
    return first.select("category", "url", "l_orderkey", "l_linenumber")


_LINK_FORMS = f"""CASE page_id % 4 WHEN 0 THEN substr(url, 6) WHEN 1 THEN '/product/' || page_id
  WHEN 2 THEN url ELSE replace(url, 'http', 'ftp') END"""


@query(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN CASE WHEN url LIKE 'http://%' THEN 'https:' || substr(url, 6) ELSE '' END
  WHEN 1 THEN '{BASE}/product/' || page_id WHEN 2 THEN url ELSE '' END AS url FROM pages""")
def normalized_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.expr(_LINK_FORMS).alias("url"))
    return discovery.normalized_links(links, SITE)


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_type ELSE 'leaf-' || p_partkey END AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'https://elsewhere.example.org/leaf-' || p_partkey WHEN 1 THEN '{BASE}/catalog/' || p_type
    ELSE '{BASE}/catalog/' || p_type || '/leaf-' || p_partkey END AS url,
  CASE WHEN p_partkey % 3 = 1 THEN p_type ELSE 'leaf-' || p_partkey END AS slug FROM part""")
def category_from_slug(spark, sf_dir):
    slug = F.expr("""CASE p_partkey % 3 WHEN 0 THEN concat('https://elsewhere.example.org/leaf-', p_partkey, '/')
                     WHEN 1 THEN p_type ELSE concat('/', p_type, '/leaf-', p_partkey, '/') END""")
    return discovery.category_from_slug(table(spark, sf_dir, "part").select("p_partkey", slug.alias("slug")), SITE)


@query(f"""SELECT slug AS name, '{BASE}/catalog/' || slug AS url, slug, arg_min(page_id, (page_id, place)) AS page, arg_min(place + (page_id + 1) % 2, (page_id, place)) AS pos FROM
(SELECT page_id, slug, row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS place FROM
  (SELECT page_id, lower(unnest(words)) AS slug, generate_subscripts(words, 1) AS i FROM
    (SELECT page_id, regexp_extract_all(html, 'href="/([A-Za-z0-9][A-Za-z0-9-]*)"', 1) AS words FROM pages))
 GROUP BY page_id, slug)
WHERE slug <> 'category' GROUP BY slug""")
def discovered_categories(spark, sf_dir):
    """The navigation links of every page as category links, in the legacy form on each second page."""
    href = 'href="/([A-Za-z0-9][A-Za-z0-9-]*)"'
    words = F.transform(F.regexp_extract_all("html", F.lit(href), F.lit(1)), F.lower)
    link = F.when(F.col("page_id") % 2 == 0, f'<a href="{BASE}/catalog/category/view/s/%s/id/7/">').otherwise(
        f'<a href="{BASE}/catalog/%s/sub">'
    )
    nav = F.array_join(F.transform(words, lambda w: F.replace(link, F.lit("%s"), w)), "\n")
    landing = table(spark, sf_dir, "pages").select(F.col("page_id").alias("position"), nav.alias("html"))
    found = discovery.discover_categories(landing, SITE)
    return found.select("name", "url", "slug", F.col("position.page").alias("page"), F.col("position.pos").cast("bigint").alias("pos"))


@query("""SELECT s_suppkey, CASE WHEN ok THEN 'APP' || s_suppkey END AS application_id, CASE WHEN ok THEN 'a2V5=' END AS api_key,
  CASE WHEN ok THEN 'shop_' || s_nationkey || '_products' END AS products_index, CASE WHEN ok THEN '' || s_suppkey END AS category_id
FROM (SELECT *, s_suppkey % 4 <> 3 AS ok FROM supplier)""")
def listing_config(spark, sf_dir):
    settings = F.format_string(
        '<script>var c = {"applicationId":"APP%d", "indexName" : "shop_%d", "apiKey":"a2V5="};'
        'push({"event":"page",%s"category_name":"x"});</script>',
        "s_suppkey",
        "s_nationkey",
        F.when(F.col("s_suppkey") % 4 == 3, "").otherwise(F.format_string('"category_id":"%d",', "s_suppkey")),
    )
    landing = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("url"), settings.alias("html"))
    return listings.extract_listing_config(landing).select(F.col("url").alias("s_suppkey"), "config.*")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, 's-' || l_suppkey AS shown_in FROM lineitem
WHERE l_linenumber % 5 <> 0""")
def listing_filter(spark, sf_dir):
    """Visible hits of every category, as one join."""
    lineitem = table(spark, sf_dir, "lineitem")
    hits = inputs.listing_hits(lineitem).withColumn("l_partkey", F.regexp_extract("url", r"p-(\d+)", 1).cast("bigint"))
    shown = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("category_id"), F.concat(F.lit("s-"), "s_suppkey").alias("shown_in")
    )
    found = listings.filter_listing_by_categories(hits, shown)
    return found.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "shown_in")


@query("SELECT count(*) AS hits FROM lineitem WHERE l_linenumber % 5 <> 0")
def listing_filter_one_category(spark, sf_dir):
    hits = inputs.listing_hits(table(spark, sf_dir, "lineitem"))
    return listings.filter_listing(hits, "all").agg(F.count("*").alias("hits"))


@query(f"""SELECT CASE l_linenumber % 4 WHEN 3 THEN 'category' WHEN 2 THEN 'product' ELSE 'other' END AS page_type, count(*) AS n
FROM lineitem GROUP BY 1""")
def classified_pages(spark, sf_dir):
    typed = pages.classify_pages(inputs.listing_hits(table(spark, sf_dir, "lineitem")), SITE)
    return typed.groupBy("page_type").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, p_name FROM part
WHERE len(list_intersect(string_split(lower(p_name || ' ' || p_type), ' '), ['small', 'red', 'promo', 'kits'])) > 0""")
def intent_filter(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_name").alias("name"), F.col("p_type").alias("slug"))
    return discovery.filter_by_intent(named, "Small, RED promo-kits!").select("p_partkey", "p_name")


INTENT = "Standrad promos, blu ANVILS"


@query(f"""WITH texts AS (SELECT p_brand || '-' || p_type AS slug, p_name AS t FROM part
  UNION ALL SELECT DISTINCT p_brand || '-' || p_type, p_type || ' ' || p_brand || '-' || p_type FROM part),
words AS (SELECT slug, unnest(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda w: w <> '')) AS w FROM texts),
runs AS (SELECT slug, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS g FROM words),
asked AS (SELECT unnest(list_filter(regexp_split_to_array(lower('{INTENT}'), '[^a-z0-9]+'), lambda w: w <> '')) AS w),
wanted AS (SELECT DISTINCT unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS g FROM asked),
lengths AS (SELECT slug, count(*) AS len FROM runs GROUP BY 1),
met AS (SELECT slug, g, count(*) AS n FROM runs WHERE g IN (SELECT g FROM wanted) GROUP BY 1, 2),
weights AS (SELECT g, ln(1 + ((SELECT count(*) FROM lengths) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM met GROUP BY 1),
scores AS (SELECT slug, sum(idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lengths)))) AS score
  FROM met JOIN weights USING (g) JOIN lengths USING (slug) GROUP BY 1)
SELECT slug, round(score, 6) AS score FROM scores WHERE score >= 0.3 * (SELECT max(score) FROM scores)""")
def ranked_intent(spark, sf_dir):
    """Categories of a brand and a type, by a misspelt intent."""
    part = table(spark, sf_dir, "part").withColumn("slug", F.concat("p_brand", F.lit("-"), "p_type"))
    categories = part.select("slug", F.col("p_type").alias("name")).distinct()
    ranked = intent.rank_by_intent(categories, part.select("slug", F.col("p_name").alias("title")), INTENT)
    return ranked.select("slug", F.round("score", 6).alias("score"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, 's-' || l_suppkey AS source_category FROM lineitem""")
def source_category(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", F.concat(F.lit(f"{BASE}/catalog/s-"), "l_suppkey").alias("category_url")
    )
    shown = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit(f"{BASE}/catalog/s-"), "s_suppkey").alias("url"), F.concat(F.lit("s-"), "s_suppkey").alias("slug")
    )
    return discovery.attach_source_category(listed, shown).drop("category_url")


# --- 2.1 and 2.6 listings --------------------------------------------------------------------------

LISTED = f"""(SELECT *, rn // 7 AS page_no, rn % 7 AS hit_pos FROM
  (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {SEEN_SQL}) - 1 AS rn,
          CASE l_suppkey % 7 WHEN 3 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 2 ELSE count(*) OVER (PARTITION BY l_suppkey) END AS stop FROM lineitem)
  WHERE rn // 7 < stop)"""


@query(f"""SELECT 's-' || l_suppkey AS category, CAST(page_no AS INT) AS page_no, CAST(hit_pos AS INT) AS hit_pos, l_partkey,
  ceil(n / 7)::BIGINT AS pages FROM {LISTED} JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) USING (l_suppkey)""")
def listing_pages(spark, sf_dir):
    """Replies read page by page until the last, a lost or an empty one."""
    replies = materialize(inputs.listing_replies(table(spark, sf_dir, "lineitem")), "replies")
    readable = listings.readable_pages(replies, SITE)
    hits = listings.explode_listing(readable)
    partkey = F.regexp_extract("url", r"p-(\d+)", 1).cast("bigint")
    return hits.select("category", "page_no", "hit_pos", partkey.alias("l_partkey"), "pages")


@query(f"""SELECT 's-' || l_suppkey AS category, l_orderkey, l_linenumber, l_suppkey, rn AS hit_no, (rn - 1) // 7 AS page, n > 350 AS hit_page_cap
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {SEEN_SQL}) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n
      FROM lineitem) WHERE rn <= 350""")
def paged_listing(spark, sf_dir):
    small = replace(SITE, hits_per_page=7, listing_max_pages=50)
    paged = listings.page_listing(inputs.listing_hits(table(spark, sf_dir, "lineitem")), small, order=SEEN)
    return paged.select(
        "category", "l_orderkey", "l_linenumber", "l_suppkey", F.col("hit_no").cast("bigint").alias("hit_no"), "page", "hit_page_cap"
    )


@query("SELECT s_suppkey AS position, s_name AS name FROM supplier ORDER BY s_suppkey LIMIT 25")
def capped_categories(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_name").alias("name"))
    return ordering.cap_categories(named, 25)


@query(f"""SELECT 's-' || l_suppkey AS category, l_orderkey, l_linenumber, l_suppkey
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {SEEN_SQL}) AS rn FROM lineitem) WHERE rn <= 20""")
def capped_products_per_category(spark, sf_dir):
    hits = inputs.listing_hits(table(spark, sf_dir, "lineitem"))
    return ordering.cap_products_per_category(hits, 20, SEEN).select("category", "l_orderkey", "l_linenumber", "l_suppkey")


# --- recommendations -------------------------------------------------------------------------------



@query(f"""SELECT '' || p_partkey AS sku, unit_pos, product_pos, rec_sku, rec_url FROM part, (VALUES (0)) AS t(x),
  LATERAL (VALUES (1, 0, '' || (p_partkey + 1), '//shop.example.com/product/p-' || (p_partkey + 1)), (1, 1, '' || p_partkey, '/product/p-' || p_partkey),
    (1, 3, '' || (p_partkey + 2), '/product/p-' || (p_partkey + 2)), (3, 0, '' || (p_partkey + 2), '/product/p-' || (p_partkey + 2)),
    (3, 1, 'no-url', NULL), (3, 2, '' || (p_partkey + 3), '{BASE}/product/p-' || (p_partkey + 3)), (3, 3, NULL, '/product/no-sku'))
  AS r(unit_pos, product_pos, rec_sku, rec_url) WHERE p_partkey % 4 <> 0""")
def exploded_recs(spark, sf_dir):
    return recs.explode_recs(inputs.recs_replies(inputs.parts(spark, sf_dir)))


@query(f"""SELECT '' || l_suppkey AS sku, string_agg('{BASE}/product/p-' || l_partkey, '|' ORDER BY l_linenumber, l_orderkey, l_partkey, l_extendedprice) AS alternatives
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber, l_orderkey, l_partkey, l_extendedprice) AS place FROM
  (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_linenumber, l_orderkey, l_extendedprice) AS seen
   FROM lineitem WHERE l_partkey <> l_suppkey) WHERE seen = 1) WHERE place <= 8 GROUP BY l_suppkey""")
def top_alternatives(spark, sf_dir):
    found = alternatives.top_alternatives(inputs.recommended(table(spark, sf_dir, "lineitem")), site=SITE)
    return found.select("sku", joined(F.col("alternatives")).alias("alternatives"))


# What the replies of ``inputs.recs_replies`` amount to.
TOP_RECS = f"""(SELECT p_partkey AS rk, '{BASE}/product/p-' || (p_partkey + 1) || '|{BASE}/product/p-' || (p_partkey + 2)
  || '|{BASE}/product/p-' || (p_partkey + 3) AS alternatives FROM part WHERE p_partkey % 4 <> 0)"""


@query(f"""SELECT 'SKU-' || p_partkey AS sku, coalesce(alternatives, 'kept') AS alternative_products FROM part
LEFT JOIN {TOP_RECS} ON rk = p_partkey""")
def attached_alternatives(spark, sf_dir):
    part = inputs.parts(spark, sf_dir)
    found = alternatives.top_alternatives(recs.explode_recs(inputs.recs_replies(part, "SKU-")), site=SITE)
    products = part.select(F.concat(F.lit("SKU-"), "p_partkey").alias("sku"), F.array(F.lit("kept")).alias("alternative_products"))
    attached = alternatives.attach_alternatives(products, found)
    return attached.select("sku", joined(F.col("alternative_products")).alias("alternative_products"))


# --- 2.4 and 2.5 records ---------------------------------------------------------------------------


@query(f"""SELECT '' || l_partkey AS sku, method AS extraction_method, l_orderkey, l_linenumber, l_suppkey,
  strftime(l_shipdate, '%Y-%m-%d') AS extracted FROM
(SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY method_rank, score DESC, l_shipdate DESC, {SEEN_SQL}) AS rn FROM {OBS})
WHERE rn = 1""")
def dedupe_products(spark, sf_dir):
    best = dedupe.dedupe_products(observations(spark, sf_dir), SEEN)
    day = F.date_format("extracted_at", "yyyy-MM-dd").alias("extracted")
    return best.select("sku", "extraction_method", "l_orderkey", "l_linenumber", "l_suppkey", day)


@query("SELECT count(DISTINCT l_partkey) AS kept FROM lineitem")
def deduped_count(spark, sf_dir):
    return dedupe.deduped_count(observations(spark, sf_dir))


@query(f"""SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM
(SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {SEEN_SQL}) AS rn FROM lineitem) WHERE rn = 1""")
def first_seen(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem").select("l_partkey", *SEEN)
    return ordering.first_seen(lineitem, "l_partkey", SEEN).drop("l_extendedprice")


@query("""SELECT user_id, event_id, event_type FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_by_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return ordering.latest_by_key(events, "user_id", ["ts", "event_id"]).drop("ts")


@query(f"""SELECT l_orderkey, brand, n FROM
(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f, brand) AS rn FROM
  (SELECT l_orderkey, p_brand AS brand, count(*) AS n, min((l_linenumber, l_suppkey, l_partkey)) AS f
   FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 6 <> 0 GROUP BY ALL)) WHERE rn = 1""")
def brand_mode(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    variants = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    brand = F.when(F.col("l_linenumber") % 6 == 0, " ").otherwise(F.concat(F.lit(" "), "p_brand"))
    named = variants.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", brand.alias("maker"))
    return reports.brand_mode(named, "l_orderkey", "maker", ["l_linenumber", "l_suppkey", "l_partkey"])


# --- 2.1 store -------------------------------------------------------------------------------------

# All columns of a product as text: absent lists and maps as '-', times by the second.
_PRODUCT_TEXT = f"""'' || l_partkey AS sku, '-' AS item_numbers, '-' AS mfr_numbers, 'Part ' || l_partkey AS name, '{BASE}/product/p-' || l_partkey AS product_url,
  '' AS category_path, CASE WHEN l_discount > 0.05 THEN 'Brand' END AS brand, printf('%.4f', l_extendedprice) AS price, printf('%.2f', l_extendedprice) AS price_text,
  'USD' AS currency, 'InStock' AS availability, CASE WHEN l_tax > 0.04 THEN '10/box' END AS pack_size, '' AS description,
  CASE WHEN l_quantity > 25 THEN 'k=v' ELSE '-' END AS specifications, CASE WHEN l_linenumber > 4 THEN 'x|y' ELSE 'x' END AS image_urls,
  CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN 'x' ELSE '' END AS alternative_products, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS extracted_at,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'json_ld' WHEN 'RF' THEN 'dom' WHEN 'NF' THEN 'playwright_dom' WHEN 'NO' THEN 'llm_fallback' ELSE 'other' END AS extraction_method,
  's-' || l_suppkey AS source_category"""
_OLD_PRODUCT_TEXT = f"""'SKU-' || p_partkey, '-', '-', 'old ' || p_name, '{BASE}/product/p-' || p_partkey, '-', NULL, NULL, NULL, NULL, NULL, NULL, NULL, '-', '-', '-',
  '2024-01-01 00:00:00', 'json_ld', 'earlier'"""
UPSERTED_WHOLE = f"""(SELECT {_PRODUCT_TEXT} FROM
  (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem)
  WHERE rn = 1 UNION ALL SELECT {_OLD_PRODUCT_TEXT} FROM part WHERE p_partkey % 11 = 0)"""


def product_text(products):
    """Every column of a products table as text."""
    pairs = F.transform(F.map_entries("specifications"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    shown = {
        "price": F.col("price").cast("decimal(38,4)").cast("string"),
        "specifications": F.coalesce(F.array_join(pairs, "|"), F.lit("-")),
        "extracted_at": F.date_format("extracted_at", "yyyy-MM-dd HH:mm:ss"),
    }
    lists = ("item_numbers", "mfr_numbers", "category_path", "image_urls", "alternative_products")
    shown |= {name: F.coalesce(F.array_join(name, "|"), F.lit("-")) for name in lists}
    return products.select(*[shown.get(f.name, F.col(f.name)).alias(f.name) for f in PRODUCT_SCHEMA])


@query(f"SELECT * FROM {UPSERTED_WHOLE}")
def upsert_products(spark, sf_dir):
    """Sightings upserted into a table that has other products, then upserted again over themselves."""
    sightings = observations(spark, sf_dir)
    existing = inputs.prior_products(table(spark, sf_dir, "part"))
    once = store.upsert_products(existing, sightings, SEEN)
    return product_text(store.upsert_products(once, sightings, SEEN))


@query(f"SELECT * FROM {UPSERTED_WHOLE}")
def bulk_upserted_products(spark, sf_dir):
    """The table that a bulk upsert leaves, every column of it."""
    existing = inputs.prior_products(table(spark, sf_dir, "part"))
    upserted, _ = store.bulk_upsert_products(existing, observations(spark, sf_dir), SEEN)
    return product_text(upserted)


@query("SELECT count(*) AS n FROM lineitem")
def bulk_upsert_count(spark, sf_dir):
    existing = inputs.prior_products(table(spark, sf_dir, "part"))
    _, given = store.bulk_upsert_products(existing, observations(spark, sf_dir), SEEN)
    return given


STATUS = """CASE event_type WHEN 'signup' THEN 'validated' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'extracted'
  WHEN 'view' THEN 'discovered' ELSE 'done' END"""
ERROR = """CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'static fetch: HTTP 503' WHEN 1 THEN 'render timed out'
  WHEN 2 THEN 'required fields missing after LLM fallback: [''price'']' WHEN 3 THEN 'static fetch: connection reset' ELSE 'unknown' END END"""
STATES = f"""(SELECT '{BASE}/product/' || user_id AS url, 'c-' || (user_id % 7) AS category, {STATUS} AS status,
  CASE WHEN event_type = 'purchase' THEN 'S' || user_id END AS sku, {ERROR} AS error, event_id FROM events)"""
LATEST = f"""(SELECT * EXCLUDE (event_id, rn) FROM
  (SELECT *, row_number() OVER (PARTITION BY url ORDER BY event_id DESC) AS rn FROM {STATES}) WHERE rn = 1)"""


def changes(spark, sf_dir):
    return inputs.crawl_states(table(spark, sf_dir, "events"))


def current_states(spark, sf_dir):
    return ordering.latest_by_key(changes(spark, sf_dir), "url", "event_id").select(*STATE_SCHEMA.fieldNames())


@query(f"""SELECT url, category, status, sku, error FROM {LATEST}
UNION ALL SELECT '{BASE}/product/p-' || p_partkey, 'earlier', CASE p_partkey % 11 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'discovered' END,
  CASE WHEN p_partkey % 11 = 0 THEN 'SKU-' || p_partkey END, CASE WHEN p_partkey % 11 = 1 THEN 'unknown' END FROM part WHERE p_partkey % 11 < 3""")
def upsert_states(spark, sf_dir):
    existing = inputs.prior_states(table(spark, sf_dir, "part"))
    return store.upsert_states(existing, changes(spark, sf_dir), "event_id").drop("updated_at")


@query(f"SELECT * FROM {UPSERTED_WHOLE}")
def batch_table(spark, sf_dir):
    """Batches stored, one of them twice, compacted, and read back."""
    path = new_dir(spark, "products")
    products = store.products_table(spark, path)
    sightings = observations(spark, sf_dir)
    products.write_batch(sightings, 0, SEEN[::-1])
    products.write_batch(inputs.prior_products(table(spark, sf_dir, "part")), 1, "sku")
    products.write_batch(sightings, 2, SEEN)
    products.write_batch(sightings, 2, SEEN)
    return product_text(products.compact(new_dir(spark, "compacted")).read())


@query(f"""SELECT 'unique' AS rule, 'sku' AS "column", '' || l_partkey AS value, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1
UNION ALL SELECT 'unique', 'product_url', '{BASE}/product/p-' || l_partkey, count(*) FROM lineitem GROUP BY l_partkey HAVING count(*) > 1
UNION ALL SELECT 'domain', 'extraction_method', 'other', count(*) FROM lineitem WHERE l_returnflag || l_linestatus NOT IN ('AF', 'RF', 'NF', 'NO')""")
def constraint_violations(spark, sf_dir):
    return constraints.check_constraints(observations(spark, sf_dir))


@query(f"""SELECT 'unique' AS rule, 'url' AS "column", '{BASE}/product/' || user_id AS value, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 1
UNION ALL SELECT 'domain', 'status', 'unheard', count(*) FROM events WHERE event_id % 50 = 0 HAVING count(*) > 0
UNION ALL SELECT 'not_null', 'category', NULL, count(*) FROM events WHERE event_id % 70 = 0 HAVING count(*) > 0""")
def state_violations(spark, sf_dir):
    """Crawl states with unknown statuses and missing categories among them."""
    states = inputs.crawl_states(table(spark, sf_dir, "events"))
    states = states.withColumn("status", F.when(F.col("event_id") % 50 == 0, "unheard").otherwise(F.col("status")))
    return constraints.check_state_constraints(
        states.withColumn("category", F.when(F.col("event_id") % 70 == 0, None).otherwise(F.col("category")))
    )


@query(f"""SELECT 's-' || l_suppkey AS category, ceil(count(*) / 7)::BIGINT - 50 AS pages_past_cap FROM lineitem
GROUP BY l_suppkey HAVING count(*) > 350""")
def capped_listing_report(spark, sf_dir):
    """Categories that a cap of 50 reply pages would cut."""
    replies = inputs.listing_replies(table(spark, sf_dir, "lineitem"))
    return listings.pages_past_cap(replies, replace(SITE, listing_max_pages=50))


EXPORTED = f"""(SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY method_rank, score DESC, l_shipdate DESC, {SEEN_SQL}) AS rn FROM
  (SELECT o.*, l.l_discount, l.l_tax, l.l_quantity FROM {OBS} o JOIN lineitem l USING (l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice)))"""


def stored_products(spark, sf_dir):
    path = new_dir(spark, "products")
    best = dedupe.dedupe_products(observations(spark, sf_dir), SEEN)
    best.select(*PRODUCT_SCHEMA.fieldNames()).write.parquet(path)
    return store.read_products(spark, path)


_EXPORT_COLUMNS = f"""'' || l_partkey AS sku, 'Part ' || l_partkey AS name, '{BASE}/product/p-' || l_partkey AS product_url,
  printf('%.2f', l_extendedprice) AS price, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S+00:00') AS extracted_at,
  method AS extraction_method, 's-' || l_suppkey AS source_category, '' AS category_path, 'USD' AS currency, 'InStock' AS availability,
  '' AS description, CASE WHEN l_quantity % 2 = 0 THEN 'x' ELSE '' END AS alternative_products"""


@query(f"""SELECT {_EXPORT_COLUMNS}, CAST(NULL AS VARCHAR) AS item_numbers, CAST(NULL AS VARCHAR) AS mfr_numbers, CASE WHEN l_discount > 0.05 THEN 'Brand' END AS brand, CASE WHEN l_tax > 0.04 THEN '10/box' END AS pack_size,
  CASE WHEN l_quantity > 25 THEN 'k=v' ELSE '' END AS specifications, CASE WHEN l_linenumber > 4 THEN 'x|y' ELSE 'x' END AS image_urls
FROM {EXPORTED} WHERE rn = 1""")
def exported_json(spark, sf_dir):
    """Products written as JSON Lines and read back."""
    path = new_dir(spark, "export")
    export.export_json(stored_products(spark, sf_dir), path)
    lists = ("item_numbers", "mfr_numbers", "category_path", "image_urls", "alternative_products")
    kinds = {"specifications": "map<string,string>"} | dict.fromkeys(lists, "array<string>")
    lines = spark.read.schema(", ".join(f"{c} {kinds.get(c, 'string')}" for c in export.EXPORT_COLUMNS)).json(path)
    pairs = F.transform(F.map_entries("specifications"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    flat = {c: F.array_join(c, "|") for c in lists} | {"specifications": F.coalesce(F.array_join(pairs, "|"), F.lit(""))}
    return lines.withColumns(flat)


@query(f"""SELECT {_EXPORT_COLUMNS}, '' AS item_numbers, '' AS mfr_numbers, CASE WHEN l_discount > 0.05 THEN 'Brand' ELSE '' END AS brand,
  CASE WHEN l_tax > 0.04 THEN '10/box' ELSE '' END AS pack_size, CASE WHEN l_quantity > 25 THEN '{{"k":"v"}}' ELSE '' END AS specifications_json, CASE WHEN l_linenumber > 4 THEN 'x|y' ELSE 'x' END AS image_urls
FROM {EXPORTED} WHERE rn = 1""")
def exported_csv(spark, sf_dir):
    """Products written as CSV and read back."""
    out = new_dir(spark, "export")
    export.export(stored_products(spark, sf_dir), out, "csv")
    rows = spark.read.options(header="true", escape='"', multiLine="true").csv(f"{out}/products.csv").fillna("")
    return rows.select(*[export.CSV_NAMES.get(c, c) for c in export.EXPORT_COLUMNS])


# --- 2.3 frontier ------------------------------------------------------------------------------------


@query(f"""SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_partkey % 11 WHEN 1 THEN 'failed' WHEN 2 THEN 'discovered' END AS prior_status,
  l_partkey % 11 > 2 AS is_new FROM lineitem WHERE l_partkey % 11 <> 0""")
def frontier_selection(spark, sf_dir):
    listed = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(f"{BASE}/product/p-"), "l_partkey").alias("url"), "l_orderkey", "l_linenumber", "l_suppkey"
    )
    return frontier.select_frontier(listed, inputs.prior_states(table(spark, sf_dir, "part"))).drop("url")


@query(f"SELECT url, category, status, error FROM {LATEST} WHERE status IN ('failed', 'discovered')")
def urls_by_status(spark, sf_dir):
    found = frontier.urls_by_status(current_states(spark, sf_dir), "failed", "discovered")
    return found.select("url", "category", "status", "error")


@query(f"SELECT url, status, sku FROM {LATEST} WHERE url = '{BASE}/product/7'")
def state_lookup(spark, sf_dir):
    return frontier.get_state(current_states(spark, sf_dir), f"{BASE}/product/7").select("url", "status", "sku")


def laid_out_states(spark, states):
    path = new_dir(spark, "states")
    return layout.store_states(states, f"states_{path[-32:]}", path, buckets=8)


@query(f"""SELECT l_orderkey, l_linenumber, l_suppkey, CASE l_partkey % 11 WHEN 1 THEN 'failed' WHEN 2 THEN 'discovered' END AS prior_status,
  l_partkey % 11 > 2 AS is_new FROM lineitem WHERE l_partkey % 11 <> 0""")
def laid_out_frontier(spark, sf_dir):
    """The frontier from states that lie in buckets by URL."""
    listed = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(f"{BASE}/product/p-"), "l_partkey").alias("url"), "l_orderkey", "l_linenumber", "l_suppkey"
    )
    states = laid_out_states(spark, inputs.prior_states(table(spark, sf_dir, "part")))
    return frontier.select_frontier(listed, states).drop("url")


@query(f"""SELECT url, category, status, sku, error FROM {LATEST} WHERE status IN ('failed', 'discovered')
UNION ALL SELECT url, category, status, sku, error FROM {LATEST} WHERE url = '{BASE}/product/7'""")
def laid_out_lookups(spark, sf_dir):
    """States by status and by URL from the laid-out table."""
    states = laid_out_states(spark, current_states(spark, sf_dir))
    found = frontier.urls_by_status(states, "failed", "discovered").unionByName(frontier.get_state(states, f"{BASE}/product/7"))
    return found.select("url", "category", "status", "sku", "error")


RUN_FAILED = "event_type = 'error' OR (event_id % 5 = 3 AND user_id % 7 < 3 AND event_type <> 'purchase')"
CONTROL = f"""(WITH RECURSIVE history AS (
  SELECT category, run_no, x, row_number() OVER (PARTITION BY category ORDER BY run_no) AS i FROM
    (SELECT 'c-' || (user_id % 7) AS category, event_id % 5 AS run_no, CAST(count(*) FILTER ({RUN_FAILED}) AS DOUBLE) / count(*) AS x
     FROM events GROUP BY 1, 2)),
decided AS (
  SELECT category, run_no, i, x, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS var, false AS frozen, x AS next_mean, CAST(0 AS DOUBLE) AS next_var, 1 AS n
  FROM history WHERE i = 1
  UNION ALL
  SELECT category, run_no, i, x, mean, var, frozen, CASE WHEN frozen THEN mean ELSE mean + 0.3 * (x - mean) END,
    CASE WHEN frozen THEN var ELSE 0.7 * (var + 0.3 * (x - mean) * (x - mean)) END, n + CASE WHEN frozen THEN 0 ELSE 1 END FROM
  (SELECT h.category, h.run_no, h.i, h.x, d.next_mean AS mean, d.next_var AS var, d.n,
     d.n >= 2 AND h.x > greatest(d.next_mean + CASE WHEN d.frozen THEN 1.0 ELSE 3.0 END * sqrt(d.next_var), 0.05) AS frozen
   FROM decided d JOIN history h ON h.category = d.category AND h.i = d.i + 1))
SELECT * FROM decided)"""


def run_decisions(spark, sf_dir):
    failed = F.expr(RUN_FAILED)
    states = table(spark, sf_dir, "events").select(
        F.concat(F.lit("c-"), F.col("user_id") % 7).alias("category"), F.when(failed, "failed").otherwise("done").alias("status"), "event_id"
    )
    history = backpressure.run_history(states, F.col("event_id") % 5)
    return backpressure.control(history, backpressure.ControlLimits(warm_up=2))


@query(f"""SELECT category, run_no, printf('%.8f', x) AS failure_rate, printf('%.8f', mean) AS mean, printf('%.8f', sqrt(var)) AS deviation, frozen FROM {CONTROL}""")
def failure_control(spark, sf_dir):
    """Five runs; three categories fail in the fourth."""
    shown = {n: F.format_string("%.8f", n) for n in ("failure_rate", "mean", "deviation")}
    return run_decisions(spark, sf_dir).withColumns(shown)


@query(f"""SELECT c_custkey, run, category, is_new FROM (SELECT c_custkey, unnest([1, 2, 3, 4, 5]) AS run, 'c-' || (c_custkey % 9) AS category, c_custkey % 3 <> 0 AS is_new FROM customer) l
WHERE NOT is_new OR NOT coalesce((SELECT arg_max(frozen, run_no) FROM {CONTROL} c WHERE c.category = l.category AND c.run_no < l.run), false)""")
def frontier_under_control(spark, sf_dir):
    """What five runs may work on: new URLs of a frozen category leave the frontier and come back."""
    key = F.col("c_custkey")
    listed = table(spark, sf_dir, "customer").select(
        key, F.explode(F.sequence(F.lit(1), F.lit(5))).alias("run"), F.concat(F.lit("c-"), key % 9).alias("category"), (key % 3 != 0).alias("is_new")
    )
    decisions = materialize(run_decisions(spark, sf_dir), "decisions")
    return backpressure.without_frozen(listed, decisions, F.col("run"))


@query(f"""SELECT '{BASE}/product/p-' || p AS url, CASE WHEN o_orderdate > d THEN 'changed' ELSE 'old' END AS reason, o_orderkey FROM
(SELECT l_partkey AS p, max(l_shipdate) AS d FROM lineitem GROUP BY 1) JOIN
(SELECT l_partkey AS p, o_orderkey, o_orderdate FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON o_orderkey = l_orderkey)
USING (p) WHERE o_orderdate > d OR d < TIMESTAMP '2001-06-01' - INTERVAL 30 DAY""")
def refresh_frontier(spark, sf_dir):
    """Order dates as changes of the ordered parts' listings, the last shipping date as extraction time."""
    url = F.concat(F.lit(f"{BASE}/product/p-"), "l_partkey")
    lineitem = table(spark, sf_dir, "lineitem")
    products = lineitem.groupBy(url.alias("product_url")).agg(F.max("l_shipdate").alias("extracted_at"))
    ordered = lineitem.select("l_orderkey", url.alias("url")).distinct()
    dates = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("lastmod"))
    listing = ordered.join(dates, ordered.l_orderkey == dates.o_orderkey).drop("l_orderkey")
    stale = frontier.refresh_frontier(listing, products, F.lit("2001-06-01 00:00:00").cast("timestamp"), 30)
    return stale.select("url", "reason", "o_orderkey")


_CHANGED = "CASE l_partkey % 3 WHEN 0 THEN date_trunc('day', l_shipdate) WHEN 1 THEN date_trunc('second', l_shipdate) ELSE date_trunc('minute', l_shipdate) END"


def sitemap_bodies(spark, sf_dir):
    """A sitemap for each five hundred orders: their parts, with the shipping date in three forms of writing it."""
    at = F.col("l_shipdate")
    written = (
        F.when(F.col("l_partkey") % 3 == 0, F.date_format(at, "yyyy-MM-dd"))
        .when(F.col("l_partkey") % 3 == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm'+02:00'"))
    )
    entry = F.format_string(f" <url><loc> {BASE}/product/p-%d?a=1&amp;b=2</loc><lastmod>%s</lastmod><priority>0.5</priority></url>", "l_partkey", written)
    lines = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 500).alias("file_no"), entry.alias("entry"))
    head = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    return lines.groupBy("file_no").agg(F.concat(F.lit(head), F.array_join(F.collect_list("entry"), ""), F.lit("</urlset>")).alias("body"))


@query(f"""SELECT '{BASE}/product/p-' || p || '?a=1&b=2' AS url, CASE WHEN lastmod > extracted_at THEN 'changed' ELSE 'old' END AS reason
FROM (SELECT l_partkey AS p, max({_CHANGED}) AS lastmod, min(l_shipdate) + INTERVAL 900 DAY AS extracted_at FROM lineitem GROUP BY 1)
WHERE lastmod > extracted_at OR extracted_at < TIMESTAMP '2001-06-01' - INTERVAL 30 DAY""")
def sitemap_stale_urls(spark, sf_dir):
    """Products to extract again by the sitemaps, which are gzipped files of one document each."""
    path = new_dir(spark, "sitemaps")
    sitemap_bodies(spark, sf_dir).select("body").write.option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)
    listed = sitemaps.listed_changes(sitemaps.read_sitemaps(spark, path))
    url = F.concat(F.lit(f"{BASE}/product/p-"), "l_partkey", F.lit("?a=1&b=2"))
    first = table(spark, sf_dir, "lineitem").groupBy(url.alias("product_url")).agg(F.min("l_shipdate").alias("first"))
    products = first.select("product_url", (F.col("first") + F.expr("INTERVAL 900 DAYS")).alias("extracted_at"))
    stale = frontier.refresh_frontier(listed, products, F.lit("2001-06-01 00:00:00").cast("timestamp"), 30)
    return stale.select("url", "reason")


@query(f"""SELECT l_orderkey // 500 AS file_no, CASE WHEN l_orderkey // 500 % 5 = 3 THEN 'corrupt' ELSE 'url' END AS kind,
  CASE WHEN l_orderkey // 500 % 5 = 3 THEN 1 ELSE count(*) END AS entries,
  CASE WHEN l_orderkey // 500 % 5 <> 3 THEN max({_CHANGED}) END AS lastmod FROM lineitem GROUP BY 1
UNION ALL SELECT -1, 'sitemap', count(DISTINCT l_orderkey // 500), NULL FROM lineitem""")
def parsed_sitemaps(spark, sf_dir):
    """Fetched sitemaps and their index, each fifth one broken: the entries of each and the last change."""
    bodies = sitemap_bodies(spark, sf_dir)
    body = F.when(F.col("file_no") % 5 == 3, F.replace("body", F.lit("</urlset>"), F.lit("</nothing>"))).otherwise(F.col("body"))
    named = F.array_join(F.collect_list(F.format_string("<sitemap><loc>%d</loc></sitemap>", "file_no")), "")
    index = bodies.agg(F.concat(F.lit("<sitemapindex>"), named, F.lit("</sitemapindex>")).alias("body")).select(F.lit("-1").alias("url"), "body")
    fetched = bodies.select(F.col("file_no").cast("string").alias("url"), body.alias("body")).unionByName(index)
    read = sitemaps.parse_sitemaps(fetched).groupBy(F.col("sitemap").cast("long").alias("file_no"), "kind")
    return read.agg(F.count(F.lit(1)).alias("entries"), F.max("lastmod").alias("lastmod"))


# --- 2.4 reports -------------------------------------------------------------------------------------


@query(f"SELECT status, count(*) AS n FROM {LATEST} GROUP BY 1")
def status_counts(spark, sf_dir):
    return reports.status_counts(current_states(spark, sf_dir))


@query("SELECT count(*) AS n FROM lineitem")
def product_count(spark, sf_dir):
    return reports.product_count(observations(spark, sf_dir))


@query(f"""SELECT 'products' AS section, 'total' AS name, count(*) AS n FROM lineitem
UNION ALL SELECT 'crawl_state', status, count(*) FROM {LATEST} GROUP BY status""")
def status_report(spark, sf_dir):
    return reports.status_report(observations(spark, sf_dir), current_states(spark, sf_dir))


def _rate(method: str) -> str:
    return f"CAST(count(*) FILTER (method = '{method}') AS DOUBLE) / count(*)"


_RATES = f"""count(*) AS products, printf('%.10f', {_rate('json_ld')}) AS json_ld_rate, printf('%.10f', {_rate('dom')}) AS dom_rate,
  printf('%.10f', {_rate('playwright_dom')}) AS playwright_dom_rate, printf('%.10f', {_rate('llm_fallback')}) AS llm_fallback_rate,
  {_rate('json_ld')} < 0.95 AS low_json_ld, {_rate('llm_fallback')} > 0.1 AS high_llm_fallback"""


def _rates_as_text(rates):
    names = [n for n in rates.columns if n.endswith("_rate")]
    return rates.withColumns({n: F.when(F.col(n).isNotNull(), F.format_string("%.10f", n)) for n in names})


@query(f"SELECT {_RATES} FROM {OBS}")
def method_rates(spark, sf_dir):
    return _rates_as_text(reports.method_rates(observations(spark, sf_dir)))


@query(f"SELECT 's-' || l_suppkey AS source_category, {_RATES} FROM {OBS} GROUP BY l_suppkey")
def method_rates_by_category(spark, sf_dir):
    return _rates_as_text(reports.method_rates(observations(spark, sf_dir), "source_category"))


@query("""SELECT CASE event_id % 5 WHEN 0 THEN '5xx' WHEN 1 THEN 'timeout' WHEN 2 THEN 'parse' WHEN 3 THEN 'fetch' ELSE 'other' END AS kind,
  count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1""")
def failure_buckets(spark, sf_dir):
    return reports.failure_buckets(changes(spark, sf_dir))


_HEALTH = f"""(SELECT category, urls, f, products, b FROM
  (SELECT 'c-' || (user_id % 7) AS category, count(*) AS urls, avg(CAST(event_type = 'error' AS INT)) AS f FROM events GROUP BY 1)
  LEFT JOIN (SELECT 'c-' || (l_suppkey % 6) AS category, count(*) AS products, avg(CAST(method = 'llm_fallback' AS INT)) AS b FROM {OBS} GROUP BY 1)
  USING (category))"""


@query(f"""SELECT category, urls, printf('%.10f', f) AS failure_rate, products, printf('%.10f', b) AS fallback_rate,
  f > 2.0 * bf AS failure_spike, coalesce(b > 2.0 * bb, false) AS fallback_spike
FROM {_HEALTH} JOIN (SELECT 'c-' || (user_id % 7) AS category, avg(CAST(event_type = 'error' AND user_id % 7 < 3 AS INT)) * 0.4 AS bf,
  CASE WHEN user_id % 7 % 2 = 0 THEN 0.05 ELSE 0.9 END AS bb FROM events GROUP BY user_id % 7) USING (category)""")
def category_health(spark, sf_dir):
    """Against a baseline with low failure rates everywhere and low fallback rates in every second category."""
    products = observations(spark, sf_dir).withColumn("source_category", F.concat(F.lit("c-"), F.col("l_suppkey") % 6))
    number = F.col("user_id") % 7
    baseline = table(spark, sf_dir, "events").groupBy(number.alias("g")).agg(
        (F.avg(((F.col("event_type") == "error") & (number < 3)).cast("int")) * 0.4).alias("failure_rate")
    )
    baseline = baseline.select(
        F.concat(F.lit("c-"), "g").alias("category"), "failure_rate", F.when(F.col("g") % 2 == 0, 0.05).otherwise(0.9).alias("fallback_rate")
    )
    health = reports.category_health(changes(spark, sf_dir), products, baseline)
    return _rates_as_text(health.drop("base_failure_rate", "base_fallback_rate"))


@query("""SELECT doc_id, source AS source_category, lang AS extraction_method, printf('%.10f', avg(quality) OVER
  (PARTITION BY source, lang ORDER BY doc_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) AS rolling_mean
FROM labels JOIN documents USING (doc_id)""")
def quality_rolling_mean(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("source_category"), F.col("lang").alias("extraction_method")
    )
    scores = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("score")).join(documents, "doc_id")
    means = reports.quality_rolling_mean(scores, "doc_id", [], 19, chunk_rows=50)
    return means.withColumn("rolling_mean", F.format_string("%.10f", "rolling_mean")).drop("score")


@query("""SELECT '' || l_partkey AS sku, count(*) AS n FROM lineitem
WHERE ('0x' || substr(md5('' || l_partkey), 1, 8))::BIGINT % 100 < 10 GROUP BY 1""")
def review_sample(spark, sf_dir):
    """A tenth of the parts' records, the same in every run."""
    return reports.sample_for_review(observations(spark, sf_dir)).groupBy("sku").agg(F.count("*").alias("n"))


_JUDGED = """(SELECT doc_id, source AS source_category, lang AS extraction_method, n_chars % 6 + 3 * quality AS score, quality FROM documents JOIN labels USING (doc_id))"""


@query(f"""WITH gold AS (SELECT score, sum(quality) AS s, count(*) AS n FROM {_JUDGED} WHERE doc_id % 3 = 0 GROUP BY score),
pooled AS (SELECT a.score AS a, b.score AS b, sum(g.s) / sum(g.n) AS mean FROM gold a JOIN gold b ON a.score <= b.score JOIN gold g ON g.score BETWEEN a.score AND b.score GROUP BY 1, 2),
fitted AS (SELECT score, max(low) AS value FROM (SELECT g.score, p.a, min(p.mean) AS low FROM gold g JOIN pooled p ON p.a <= g.score AND p.b >= g.score GROUP BY 1, 2) GROUP BY score),
sample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_category, extraction_method
  ORDER BY ('0x' || substr(md5('' || doc_id), 1, 15))::BIGINT, doc_id) AS place FROM {_JUDGED}) WHERE place <= 25)
SELECT doc_id, source_category, extraction_method, printf('%.8f', value) AS score, printf('%.8f', avg(value) OVER
  (PARTITION BY source_category, extraction_method ORDER BY doc_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) AS rolling_mean
FROM (SELECT s.*, coalesce((SELECT arg_max(f.value, f.score) FROM fitted f WHERE f.score <= s.score), (SELECT arg_min(value, score) FROM fitted)) AS value FROM sample s)""")
def reviewed_quality(spark, sf_dir):
    """25 documents of each source and language, a judge's scores calibrated on a third of the labels, and their rolling mean."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("source_category"), F.col("lang").alias("extraction_method"), "n_chars"
    )
    judged = table(spark, sf_dir, "labels").join(documents, "doc_id")
    judged = judged.withColumn("score", F.col("n_chars") % 6 + 3 * F.col("quality"))
    gold = judged.where("doc_id % 3 = 0").select("score", F.col("quality").alias("label"))
    rows = judged.select("doc_id", "source_category", "extraction_method", "score")
    means = review.reviewed_quality(rows, gold, 25, "doc_id", 9, key="doc_id", chunk_rows=20)
    return means.withColumns({c: F.format_string("%.8f", c) for c in ("score", "rolling_mean")})


# --- 2.9 whole run -----------------------------------------------------------------------------------

OCCURRENCES = f"""(SELECT l_suppkey, l_partkey, min(rn) AS rn FROM {LISTED} WHERE l_linenumber % 4 <> 3 GROUP BY 1, 2)"""
FRONTIER = f"""(SELECT l_partkey AS p_partkey, count(*) AS n, arg_min(l_suppkey, (l_suppkey, rn)) AS first_cat,
  arg_max(l_suppkey, (l_suppkey, rn)) AS last_cat, CASE l_partkey % 11 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'discovered' END AS prior
  FROM {OCCURRENCES} GROUP BY 1)"""
WORKED = f"(SELECT * FROM {FRONTIER} JOIN ({WITH_RENDERING}) USING (p_partkey) WHERE prior IS NULL OR prior <> 'done')"


def catalog_run(spark, sf_dir, given_categories=True, landing_pages=None, slugs=None, **prior):
    part = inputs.parts(spark, sf_dir)
    lineitem, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    given = catalog_job.CatalogInputs(
        categories=supplier.select(
            F.col("s_name").alias("name"),
            F.concat(F.lit(f"{BASE}/catalog/s-"), "s_suppkey", F.lit("/")).alias("url"),
            F.col("s_suppkey").alias("position"),
        ),
        listing_pages=materialize(inputs.listing_replies(lineitem), "replies"),
        pages=inputs.product_pages(part),
        products=inputs.prior_products(part),
        states=inputs.prior_states(part, **prior),
        rendered=inputs.rendered_pages(part),
        answers=inputs.fallback_replies(part),
        recs_payloads=inputs.recs_replies(part, "SKU-"),
    )
    if not given_categories:
        given = replace(given, categories=None, landing_pages=landing_pages, slugs=slugs)
    return catalog_job.run_catalog_job(given, run_at(), SITE)


RUN_STATS = f"""SELECT (SELECT count(*) FROM supplier) AS discovered_categories, (SELECT count(*) FROM {FRONTIER} WHERE prior IS NULL) AS discovered,
  count(*) FILTER (error IS NULL AND method = 'json_ld') AS extracted_jsonld,
  count(*) FILTER (error IS NULL AND method = 'playwright_dom') AS extracted_playwright,
  count(*) FILTER (error IS NULL AND method = 'llm_fallback') AS extracted_llm,
  CAST(coalesce(sum(n) FILTER (error IS NOT NULL), 0) AS BIGINT) AS failed,
  CAST(coalesce(sum(n - 1) FILTER (error IS NULL), 0) + (SELECT coalesce(sum(n), 0) FROM {FRONTIER} WHERE prior = 'done') AS BIGINT) AS skipped_done
FROM {WORKED}"""


@query(RUN_STATS)
def catalog_run_stats(spark, sf_dir):
    return catalog_run(spark, sf_dir).stats


PRIOR = "CASE l_partkey % 11 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'discovered' END"


@query(RUN_STATS)
def catalog_run_from_landing_page(spark, sf_dir):
    """A run that finds its categories on the landing pages of the nations."""
    link = F.concat(F.lit(f'<a href="{BASE}/catalog/s-'), "s_suppkey", F.lit('">s</a>'))
    landing = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("position"), link.alias("html"))
    return catalog_run(spark, sf_dir, given_categories=False, landing_pages=landing).stats


@query(RUN_STATS.replace(PRIOR, "CASE WHEN l_partkey % 100 <> 7 THEN 'done' END"))
def catalog_run_small_frontier(spark, sf_dir):
    """A run in which a hundredth of the pages has work."""
    return catalog_run(spark, sf_dir, status="CASE WHEN p_partkey % 100 <> 7 THEN 'done' END").stats


@query(f"""SELECT sku, name, CASE WHEN p_partkey IS NULL THEN '' ELSE coalesce(r.alternatives, w.alternative_products) END AS alternative_products,
  extraction_method, source_category, price_text FROM
(SELECT p_partkey, sku, name, price_text, alternative_products, method AS extraction_method, 's-' || first_cat AS source_category FROM {WORKED} WHERE error IS NULL) w
LEFT JOIN {TOP_RECS} r ON r.rk = w.p_partkey
UNION ALL SELECT 'SKU-' || p_partkey, 'old ' || p_name, '', 'json_ld', 'earlier', NULL FROM part WHERE p_partkey % 11 = 0""")
def catalog_run_products(spark, sf_dir):
    products = catalog_run(spark, sf_dir).products
    return products.select(
        "sku", "name", joined(F.col("alternative_products")).alias("alternative_products"), "extraction_method", "source_category", "price_text"
    )


@query(f"""SELECT url, 's-' || CASE WHEN error IS NULL THEN first_cat ELSE last_cat END AS category,
  CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END AS status, CASE WHEN error IS NULL THEN sku END AS sku, error FROM {WORKED}
UNION ALL SELECT '{BASE}/product/p-' || p_partkey, 'earlier', CASE p_partkey % 11 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' ELSE 'discovered' END,
  CASE WHEN p_partkey % 11 = 0 THEN 'SKU-' || p_partkey END, CASE WHEN p_partkey % 11 = 1 THEN 'unknown' END FROM part
  WHERE p_partkey % 11 < 3 AND p_partkey NOT IN (SELECT p_partkey FROM {WORKED})""")
def catalog_run_states(spark, sf_dir):
    return catalog_run(spark, sf_dir).states.drop("updated_at")


@query(f"""SELECT sku, name, price_text, extraction_method FROM (SELECT 'SKU-' || p_partkey AS sku, name, price_text, method AS extraction_method FROM {WORKED} WHERE error IS NULL)
UNION ALL SELECT 'SKU-' || p_partkey, 'old ' || p_name, NULL, 'json_ld' FROM part WHERE p_partkey % 11 = 0""")
def published_run(spark, sf_dir):
    """The products of a run, published after an earlier version."""
    path, run = new_dir(spark, "published"), catalog_run(spark, sf_dir)
    store.publish(path, products=inputs.prior_products(table(spark, sf_dir, "part")), states=run.states.limit(0))
    run.publish(path)
    return store.read_published(spark, path, "products", PRODUCT_SCHEMA).select("sku", "name", "price_text", "extraction_method")


# --- 2.11 streaming ----------------------------------------------------------------------------------


def _stream(spark, sf_dir, name):
    """A given table as a stream of files; its one file is spread over all cores."""
    schema = table(spark, sf_dir, name).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet*")
    return stream.repartition(spark.sparkContext.defaultParallelism)


@query(f"""SELECT p_partkey AS position, sku, price_text, method,
  CASE WHEN NOT has_html THEN 'static fetch: HTTP 503' WHEN missing <> '' THEN 'required fields missing without LLM fallback: [''' || replace(missing, '|', ''', ''') || ''']' END AS error
FROM ({STATIC})""")
def streamed_extraction(spark, sf_dir):
    extracted = incremental.stream_extract(inputs.product_pages(_stream(spark, sf_dir, "part")))
    out, checkpoint = new_dir(spark, "stream"), new_dir(spark, "checkpoint")
    incremental.write_stream(
        extracted.select("position", "partial.sku", "partial.price_text", "method", "error"), out, checkpoint
    ).awaitTermination()
    return spark.read.parquet(out)


@query(f"""SELECT sku, price_text, method AS extraction_method, p_type AS source_category FROM ({STATIC})
JOIN (SELECT p_partkey, p_type FROM part) USING (p_partkey) WHERE missing = ''""")
def streamed_products(spark, sf_dir):
    return _streamed_tables(spark, sf_dir)[0].read().select("sku", "price_text", "extraction_method", "source_category")


@query(f"""SELECT url, CASE WHEN missing = '' THEN 'done' ELSE 'failed' END AS status, CASE WHEN missing = '' THEN sku END AS sku FROM ({STATIC})""")
def streamed_states(spark, sf_dir):
    return _streamed_tables(spark, sf_dir)[1].read().select("url", "status", "sku")


def _streamed_tables(spark, sf_dir):
    products = store.products_table(spark, new_dir(spark, "products"))
    states = store.states_table(spark, new_dir(spark, "states"))
    extracted = incremental.stream_extract(inputs.product_pages(_stream(spark, sf_dir, "part")))
    incremental.stream_upsert(
        extracted, products, states, run_at(), "position", new_dir(spark, "checkpoint")
    ).awaitTermination()
    return products, states


def _in_files(spark, rows, files, order):
    """Rows as a stream that comes in several micro-batches, and its folder; ``order`` says which of them a row is in."""
    path = new_dir(spark, "arrivals")
    written = 1
    for k in range(files):
        # as many files as tasks build the rows; fewer files would leave the building to fewer tasks
        rows.where(order == k).write.parquet(f"{path}/{k}")
        written = max(written, len(spark.read.schema(rows.schema).parquet(f"{path}/{k}").inputFiles()))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", written).parquet(f"{path}/*"), path


@query(f"""SELECT '{BASE}/product/' || user_id AS url, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_seen FROM events GROUP BY user_id""")
def streamed_first_seen(spark, sf_dir):
    """The first time of each URL, from events that arrive out of order in several micro-batches."""
    events = table(spark, sf_dir, "events")
    rows = inputs.crawl_states(events).select("url", "updated_at", (F.col("event_id") % 3).alias("part"))
    arrivals, _ = _in_files(spark, rows, 3, F.col("part"))
    seen = store.KeyedTable(spark, new_dir(spark, "seen"), incremental.FIRST_SEEN_SCHEMA, "url")
    incremental.stream_first_seen_into(arrivals, "updated_at", timedelta(days=3650), seen, new_dir(spark, "checkpoint")).awaitTermination()
    return seen.read().select("url", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_seen"))


@query(f"SELECT url, category, status, sku, error FROM {LATEST}")
def streamed_last_writes(spark, sf_dir):
    """State changes of two writers, late ones among them: the last by event id counts, whoever wrote it."""
    rows = changes(spark, sf_dir).where(F.col("event_id").isNotNull())
    late = F.when(F.col("event_id") % 5 == 0, 2 - F.col("event_id") % 3).otherwise(F.col("event_id") % 3)
    one, other = (rows.where(F.col("event_id") % 2 == k) for k in (0, 1))
    united = _in_files(spark, one, 3, late)[0].union(_in_files(spark, other, 3, F.col("event_id") % 3)[0])
    schema = StructType([*STATE_SCHEMA.fields, StructField("event_id", LongType())])
    states = store.KeyedTable(spark, new_dir(spark, "states"), schema, "url")
    incremental.stream_last_writes(united, states, "event_id", new_dir(spark, "checkpoint")).awaitTermination()
    return states.read().select("url", "category", "status", "sku", "error")


@query(f"SELECT * FROM {UPSERTED_WHOLE}")
def interleaved_writers(spark, sf_dir):
    """Batches of two writers in turns: first sightings, then later ones, and a replay of an early batch at the end."""
    products = store.products_table(spark, new_dir(spark, "products"))
    sightings = observations(spark, sf_dir)
    products.write_batch(inputs.prior_products(table(spark, sf_dir, "part")), 0, "sku", "a")
    products.write_batch(sightings, 0, SEEN[::-1], "b")
    products.write_batch(sightings, 1, SEEN, "a")
    products.write_batch(sightings, 0, SEEN[::-1], "b")
    return product_text(products.read())


CASCADE_TEXT = """url, sku, name, price_text, method, missing, error"""


def _cascade_streams(spark, sf_dir):
    """Pages, renderings and answers as three streams of three files each: those of part p are dated p seconds after the
    start, and every third rendering and answer comes two files late. Returns them with their folders."""
    part = inputs.parts(spark, sf_dir)
    key = F.regexp_extract("url", r"p-(\d+)", 1).try_cast("bigint")
    late = F.when(key % 3 == 0, F.lit(2)).otherwise(F.floor(key / 3) % 2)
    after = lambda seconds: F.timestamp_seconds(F.unix_timestamp(run_at()) + key + seconds)
    pages = inputs.product_pages(part).withColumn("fetched_at", after(0))
    rendered = inputs.rendered_pages(part).withColumn("rendered_at", after(60))
    answers = inputs.fallback_replies(part).withColumn("answered_at", after(600))
    return [_in_files(spark, rows, 3, order) for rows, order in ((pages, F.col("position") % 3), (rendered, late), (answers, late))]


def _time_goes_on(spark, stream, path, days):
    """A row without content, dated so many days after the start, as it comes with any later traffic."""
    last = {"url": F.lit("last"), stream.columns[-1]: F.timestamp_seconds(F.unix_timestamp(run_at()) + days * 86400)}
    row = [last.get(c, F.lit(None)).cast(t).alias(c) for c, t in stream.dtypes]
    spark.range(1).select(*row).write.parquet(f"{path}/later-{days}")


@query(f"""SELECT url, sku, name, price_text, method, missing, error FROM ({WITH_RENDERING})""")
def streamed_cascade(spark, sf_dir):
    """The tiers over streams with late renderings and answers: the same outcomes as of the batch plan."""
    streams = _cascade_streams(spark, sf_dir)
    (pages, _), (rendered, _), (answers, _) = streams
    waiting = streamed.Waiting("1 hour", "1 hour", "50 days")
    tiers = [(new_dir(spark, f"tier-{k}"), new_dir(spark, "checkpoint")) for k in range(3)]

    def stored(k):
        return spark.readStream.schema(spark.read.parquet(tiers[k][0]).schema).parquet(tiers[k][0])

    steps = [lambda: streamed.stream_static(pages), lambda: streamed.stream_rendering(stored(0), rendered, waiting)]
    steps.append(lambda: streamed.stream_answers(stored(1), answers, waiting))
    # an outer join gives up on what is missing once time has gone on
    for stream, path in streams:
        _time_goes_on(spark, stream, path, 100)
    for step, (out, checkpoint) in zip(steps, tiers):
        incremental.write_stream(step(), out, checkpoint).awaitTermination()
    settled, _ = cascade.split_tier(spark.read.parquet(tiers[0][0]))
    columns = ["url", "partial.sku", "partial.name", "partial.price_text", "method", joined(F.col("missing")).alias("missing"), "error"]
    return settled.select(*columns).unionByName(spark.read.parquet(tiers[2][0]).select(*columns)).where("url <> 'last'")
