"""Input tables of the operators, derived by Spark from the given test tables.

The test tables hold no product pages, so pages are written from ``part``: one page per part in one
of eight shapes, and the oracle states the expected fields from the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalogspark.schemas import PRODUCT_SCHEMA
from catalogspark.site import SiteConfig
from catalogspark.sources.store import make_state

SITE = SiteConfig()
RUN_AT = "2024-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` spread over all cores: its file is one split, but the pages written from it are not small."""
    return table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism, "p_partkey")


def run_at() -> Column:
    return F.lit(RUN_AT).cast("timestamp")


def _q(text: str) -> str:
    return text.replace("'", '"')


def part_description() -> Column:
    """A description that names the pack size in one of five wordings, or not at all (part % 7)."""
    return F.expr(
        """CASE p_partkey % 7
             WHEN 0 THEN concat(p_size + 10, ' gloves per box') WHEN 1 THEN concat(p_size + 10, ' per case')
             WHEN 2 THEN concat('Box of ', p_size + 10) WHEN 3 THEN concat('Each bag contains ', p_size + 10)
             WHEN 4 THEN concat(p_size + 10, ' ct/pack') WHEN 5 THEN 'Quantity: a few' ELSE 'Sold singly' END"""
    )


def _escaped_description() -> Column:
    """Every third description is wrapped in markup that was escaped twice."""
    wrapped = F.concat(
        F.lit("&lt;p&gt;"), part_description(), F.lit("&amp;nbsp;&lt;br /&gt;"), F.col("p_type"), F.lit("&lt;/p&gt;")
    )
    return F.when(F.col("p_partkey") % 3 == 0, wrapped).otherwise(part_description())


def _product_json(shape: Column) -> Column:
    """The Product object, in the dialect of the shape."""
    offer = F.format_string(
        _q("{'@type':'Offer',%s'priceCurrency':'USD','availability':'%s'}"),
        F.when(shape == 4, "").otherwise(F.format_string(_q("'price':'%.2f',"), "p_retailprice")),
        F.expr(
            """CASE p_size % 3 WHEN 0 THEN 'https://schema.org/InStock' WHEN 1 THEN 'OutOfStock'
               ELSE 'https://schema.org/LimitedAvailability' END"""
        ),
    )
    image = F.format_string("https://img.example.com/%d.jpg", "p_partkey")
    product = F.format_string(
        _q("{'@context':'https://schema.org','@type':'Product','sku':' SKU-%d ','name':'%s','description':'%s',"
           "'brand':%s,'image':%s,'url':'%s/product/p-%d','offers':%s}"),
        "p_partkey",
        "p_name",
        _escaped_description(),
        F.when(shape == 6, _q("'Seller'")).otherwise(_q("{'@type':'Brand','name':'Seller'}")),
        F.when(shape == 7, F.concat(F.lit('"'), image, F.lit('"'))).otherwise(
            F.concat(F.lit('["'), image, F.lit('","'), image, F.lit('?v=2"]'))
        ),
        F.lit(SITE.base),
        "p_partkey",
        F.when(shape == 1, F.concat(F.lit("["), offer, F.lit("]"))).otherwise(offer),
    )
    return (
        F.when(shape == 2, F.concat(F.lit('{"@graph":['), product, F.lit("]}")))
        .when(shape == 3, F.concat(F.lit('[{"@type":"WebSite"},'), product, F.lit("]")))
        .when(shape == 5, F.concat(product, F.lit(",,")))
        .otherwise(product)
    )


def _breadcrumb_json() -> Column:
    crumb = "{'@type':'ListItem','position':%d,'name':'%s'}"
    crumbs = ",".join(crumb.replace("%d", str(i)) for i in (4, 2, 1, 3))
    return F.format_string(
        _q("{'@type':'BreadcrumbList','itemListElement':[" + crumbs + "]}"), "p_name", "p_brand", F.lit("Home"), "p_type"
    )


def _master_data_script() -> Column:
    """Two variants, the second one listed first, with every quote escaped; absent on each fifth page."""
    variant = "'%s':{'sku':'%s','manufacturer_part_number':'%s','manufacturer_name':'%s','position':%d}"
    text = F.format_string(
        _q("{" + variant + "," + variant + "}"),
        F.concat(F.lit("z"), "p_partkey"),
        F.concat("p_partkey", F.lit("-2")),
        F.concat(F.lit("M2-"), "p_partkey"),
        "p_brand",
        F.lit(2),
        F.concat(F.lit("a"), "p_partkey"),
        F.concat("p_partkey", F.lit("-1")),
        F.concat(F.lit("M1-"), "p_partkey"),
        "p_brand",
        F.lit(1),
    )
    script = F.concat(
        F.lit('<script>window.masterData = "'), F.replace(text, F.lit('"'), F.lit("\\u0022")), F.lit('";</script>')
    )
    return F.when(F.col("p_partkey") % 5 == 0, "").otherwise(script)


def _markup_block() -> Column:
    """Pack size, specifications and related links, on two of every four groups of eight pages."""
    group = F.floor(F.col("p_partkey") / 8) % 4
    table_rows = F.format_string(
        '<div class="product-pack-size"> <b>%d</b>/tray</div>'
        '<table class="data table"><tr><th>Size</th><td>%d<tr><th> Type </th><td>%s</td></tr>'
        "<tr><td>no head</td></tr><tr><th>Size</th><td>%d cm</td></tr></table>",
        "p_size",
        "p_size",
        "p_type",
        "p_size",
    )
    links = F.format_string(
        '<div class="related-products"><ul><li><a href="/product/p-%d">x</a><li><a href="/catalog/y">y</a>'
        '<li><a href="/product/p-%d">x</a></ul><br></div><a href="/product/outside">z</a>'
        '<ul class="product-items"><li><a class="product-item-link big" href="/product/q-%d">q</a></li></ul>',
        "p_partkey",
        "p_partkey",
        "p_partkey",
    )
    return F.when(group == 1, table_rows).when(group == 3, links).otherwise("")


def page_html(shape: Column) -> Column:
    return F.concat(
        F.lit('<!DOCTYPE html><html><head><SCRIPT type="application/ld+json">\n'),
        _product_json(shape),
        F.lit("\n</SCRIPT><script data-x='1' type='application/ld+json'>"),
        _breadcrumb_json(),
        F.lit("</script>"),
        _master_data_script(),
        F.lit("</head><body><br><p>"),
        F.col("p_name"),
        _markup_block(),
        F.lit("</body></html>"),
    )


def product_url() -> Column:
    return F.format_string(f"{SITE.base}/product/p-%d", "p_partkey")


def product_pages(part: DataFrame) -> DataFrame:
    """One fetched page per part in shape part % 8; each 97th fetch failed."""
    failed = F.col("p_partkey") % 97 == 5
    return part.select(
        product_url().alias("url"),
        F.col("p_type").alias("category"),
        F.col("p_partkey").alias("position"),
        F.when(~failed, page_html(F.col("p_partkey") % 8)).alias("html"),
        F.when(failed, "HTTP 503").alias("fetch_error"),
    )


def _incomplete(part: DataFrame) -> DataFrame:
    return part.where((F.col("p_partkey") % 8).isin(4, 5))


def rendered_pages(part: DataFrame) -> DataFrame:
    """Renderings of incomplete pages: whole for part % 3 = 0, still without price for 1, none for 2."""
    shape = F.when(F.col("p_partkey") % 3 == 0, 0).otherwise(4)
    shown = _incomplete(part).where(F.col("p_partkey") % 3 != 2)
    return shown.select(product_url().alias("url"), page_html(shape).alias("html"))


def fallback_replies(part: DataFrame) -> DataFrame:
    """Replies for the incomplete pages with part % 3 = 1: fenced, plain, or no JSON at all (part % 4)."""
    answer = F.format_string(
        _q("{'sku':'A-%d','name':'Answer %d','price':'%.2f','brand':'','currency':'EUR',"
           "'pack_size':'5/kit','image_urls':['https://img.example.com/a.jpg'],'category_path':['Answers']}"),
        "p_partkey",
        "p_partkey",
        "p_retailprice",
    )
    content = (
        F.when(F.floor(F.col("p_partkey") / 8) % 4 == 3, "I found no product.")
        .when(F.col("p_partkey") % 8 == 4, F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .otherwise(answer)
    )
    asked = _incomplete(part).where(F.col("p_partkey") % 3 == 1)
    return asked.select(product_url().alias("url"), content.alias("content"))


# --- records, states, listings -----------------------------------------------------------------

SEEN = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]


def observations(lineitem: DataFrame) -> DataFrame:
    """Each line item as a sighting of its part: a product record plus the order of sightings."""
    some = F.array(F.lit("x"))
    two = F.array(F.lit("x"), F.lit("y"))
    none = F.array().cast("array<string>")
    values = {
        "sku": F.col("l_partkey").cast("string"),
        "name": F.concat(F.lit("Part "), "l_partkey"),
        "product_url": F.concat(F.lit(f"{SITE.base}/product/p-"), "l_partkey"),
        "category_path": none,
        "brand": F.when(F.col("l_discount") > 0.05, "Brand"),
        "price": F.round("l_extendedprice", 2).cast("decimal(38,10)"),
        "price_text": F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
        "currency": F.lit("USD"),
        "availability": F.lit("InStock"),
        "pack_size": F.when(F.col("l_tax") > 0.04, "10/box"),
        "description": F.lit(""),
        "specifications": F.when(F.col("l_quantity") > 25, F.create_map(F.lit("k"), F.lit("v"))),
        "image_urls": F.when(F.col("l_linenumber") > 4, two).otherwise(some),
        "alternative_products": F.when(F.col("l_quantity") % 2 == 0, some).otherwise(none),
        "extracted_at": F.col("l_shipdate").cast("timestamp"),
        "extraction_method": F.expr(
            """CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'json_ld' WHEN 'RF' THEN 'dom'
               WHEN 'NF' THEN 'playwright_dom' WHEN 'NO' THEN 'llm_fallback' ELSE 'other' END"""
        ),
        "source_category": F.concat(F.lit("s-"), "l_suppkey"),
    }
    typed = [
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PRODUCT_SCHEMA.fields
    ]
    return lineitem.select(*typed, *SEEN)


def crawl_states(events: DataFrame) -> DataFrame:
    """Each event as a state change of its user's URL."""
    return events.select(
        F.concat(F.lit(f"{SITE.base}/product/"), "user_id").alias("url"),
        F.concat(F.lit("c-"), F.col("user_id") % 7).alias("category"),
        F.expr(
            """CASE event_type WHEN 'signup' THEN 'validated' WHEN 'error' THEN 'failed'
               WHEN 'click' THEN 'extracted' WHEN 'view' THEN 'discovered' ELSE 'done' END"""
        ).alias("status"),
        F.when(F.col("event_type") == "purchase", F.concat(F.lit("S"), "user_id")).alias("sku"),
        F.when(
            F.col("event_type") == "error",
            F.expr(
                """CASE event_id % 5 WHEN 0 THEN 'static fetch: HTTP 503' WHEN 1 THEN 'render timed out'
                   WHEN 2 THEN 'required fields missing after LLM fallback: [''price'']'
                   WHEN 3 THEN 'static fetch: connection reset' ELSE 'unknown' END"""
            ),
        ).alias("error"),
        F.col("ts").cast("timestamp").alias("updated_at"),
        "event_id",
    )


def listing_hits(lineitem: DataFrame) -> DataFrame:
    """Each line item as a hit in its supplier's category."""
    return lineitem.select(
        F.concat(F.lit("s-"), "l_suppkey").alias("category"),
        F.expr(
            f"""CASE l_linenumber % 4 WHEN 0 THEN concat('/product/p-', l_partkey)
                WHEN 1 THEN concat(' {SITE.base}/product/p-', l_partkey, '/')
                WHEN 2 THEN concat('{SITE.base}/product/p-', l_partkey)
                ELSE concat('{SITE.base}/catalog/p-', l_partkey) END"""
        ).alias("url"),
        F.array(F.col("l_suppkey").cast("string"), F.lit("all")).alias("categoryIds"),
        F.when(F.col("l_linenumber") % 5 == 0, 0).otherwise(1).alias("visibility_catalog"),
        *SEEN,
    )


def categories(supplier: DataFrame) -> DataFrame:
    """Each supplier as a category, with some links that are none."""
    return supplier.select(
        F.expr("CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat(' ', s_name, ' ') END").alias("name"),
        F.expr(
            f"""CASE s_suppkey % 5 WHEN 0 THEN concat('/catalog/s-', s_suppkey)
                WHEN 1 THEN concat('{SITE.base}/catalog/s-', s_suppkey, '/')
                WHEN 2 THEN concat(' HTTPS://www.shop.example.com/catalog/s-', s_suppkey, ' ')
                WHEN 3 THEN concat('{SITE.base}/catalog/s-', s_suppkey, '/sub')
                ELSE concat('{SITE.base}/catalog/', CASE WHEN s_suppkey % 2 = 0 THEN 'category' ELSE 'shared' END) END"""
        ).alias("url"),
        F.col("s_suppkey").alias("position"),
    )


def listing_replies(lineitem: DataFrame, page_size: int = 7) -> DataFrame:
    """Search replies per category and page; a few pages are lost, empty or not JSON."""
    hits = listing_hits(lineitem)
    no = F.row_number().over(Window.partitionBy("category").orderBy(*SEEN)) - 1
    numbered = hits.withColumn("no", no.cast("long")).select(
        "category", "url", "no", F.floor(F.col("no") / page_size).alias("page_no")
    )
    pages = numbered.groupBy("category", "page_no").agg(
        F.array_sort(F.collect_list(F.struct("no", "url"))).alias("hits")
    )
    sizes = hits.groupBy("category").agg(F.ceil(F.count("*") / page_size).alias("nbPages"))
    reply = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.transform("hits", lambda h: F.struct(h["url"].alias("url"), h["no"].alias("objectID"))).alias("hits"),
                    F.col("nbPages"),
                )
            ).alias("results")
        )
    )
    key = F.substring_index("category", "-", -1).cast("bigint")
    payload = (
        F.when((key % 7 == 3) & (F.col("page_no") == 4), F.lit(None))
        .when((key % 7 == 4) & (F.col("page_no") == 3), '{"results":[]}')
        .when((key % 7 == 5) & (F.col("page_no") == 2), "busy")
        .otherwise(reply)
    )
    return pages.join(sizes, "category").select(
        "category", F.col("page_no").cast("int").alias("page_no"), payload.alias("payload")
    )


def recs_replies(part: DataFrame, prefix: str = "") -> DataFrame:
    """One reply per part that recommends itself and its three successors, one of them twice, and malformed
    entries in between; each fourth reply is empty."""
    key = F.col("p_partkey")

    def product(n: int, host: str) -> Column:
        text = '{"sku":"' + prefix + '%d","name":"x","url":"' + host + '/product/p-%d"}'
        return F.format_string(text, key + n, key + n)

    units = F.concat_ws(
        ",",
        F.lit("null"),
        F.concat(
            F.lit('{"unitName":"a","products":['),
            F.concat_ws(",", product(1, "//shop.example.com"), product(0, ""), F.lit("null"), product(2, "")),
            F.lit("]}"),
        ),
        F.lit('{"products":"none"}'),
        F.concat(
            F.lit('{"products":['),
            F.concat_ws(",", product(2, ""), F.lit('{"sku":"no-url"}'), product(3, SITE.base), F.lit('{"url":"/product/no-sku"}')),
            F.lit("]}"),
        ),
    )
    payload = F.when(key % 4 == 0, '{"results":[]}').otherwise(F.concat(F.lit('{"results":['), units, F.lit("]}")))
    return part.select(F.concat(F.lit(prefix), key).alias("sku"), payload.alias("payload"))


def recommended(lineitem: DataFrame) -> DataFrame:
    """Line items as recommendations: a supplier's number as the SKU that gets its parts recommended."""
    url = F.when(
        F.col("l_linenumber") % 3 == 0, F.concat(F.lit("//shop.example.com/product/p-"), "l_partkey")
    ).otherwise(F.concat(F.lit("/product/p-"), "l_partkey"))
    return lineitem.select(
        F.col("l_suppkey").cast("string").alias("sku"),
        F.col("l_linenumber").alias("unit_pos"),
        F.struct("l_orderkey", "l_partkey", "l_extendedprice").alias("product_pos"),
        F.col("l_partkey").cast("string").alias("rec_sku"),
        url.alias("rec_url"),
    )


def prior_states(
    part: DataFrame, status: str = "CASE p_partkey % 11 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'discovered' END"
) -> DataFrame:
    """States of an earlier run: of every eleven parts one is done, one failed and one only discovered, unless told otherwise."""
    status = F.expr(status)
    before = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return part.where(status.isNotNull()).select(
        *make_state(
            product_url(),
            F.lit("earlier"),
            status,
            F.when(status == "done", F.concat(F.lit("SKU-"), "p_partkey")),
            F.when(status == "failed", "unknown"),
            before,
        )
    )


def prior_products(part: DataFrame) -> DataFrame:
    """Products of the earlier run: the parts that are done."""
    values = {
        "sku": F.concat(F.lit("SKU-"), "p_partkey"),
        "name": F.concat(F.lit("old "), "p_name"),
        "product_url": product_url(),
        "extracted_at": F.lit("2024-01-01 00:00:00"),
        "extraction_method": F.lit("json_ld"),
        "source_category": F.lit("earlier"),
    }
    done = part.where(F.col("p_partkey") % 11 == 0)
    return done.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PRODUCT_SCHEMA.fields]
    )
