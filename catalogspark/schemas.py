"""Table schemas: every table the operators read or write."""

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())
STRING_MAP = T.MapType(T.StringType(), T.StringType())
PRICE = T.DecimalType(38, 10)

# The domains of the three enumerated columns.
METHODS = ("json_ld", "dom", "playwright_dom", "llm_fallback")
STATUSES = ("discovered", "extracted", "validated", "done", "failed")
AVAILABILITIES = ("InStock", "OutOfStock", "PreOrder", "Discontinued", "Unknown")

# A page is complete once these three fields are filled.
REQUIRED_FIELDS = ("name", "price", "sku")


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


PAGE_SCHEMA = _struct(
    ("url", T.StringType(), False),
    ("category", T.StringType(), True),
    ("position", T.LongType(), True),
    ("fetched_at", T.TimestampType(), True),
    ("html", T.StringType(), True),
    ("fetch_error", T.StringType(), True),
)

CATEGORY_SCHEMA = _struct(
    ("name", T.StringType(), True),
    ("url", T.StringType(), False),
    ("slug", T.StringType(), False),
    ("position", T.LongType(), False),
)

STATE_SCHEMA = _struct(
    ("url", T.StringType(), False),
    ("category", T.StringType(), False),
    ("status", T.StringType(), False),
    ("sku", T.StringType(), True),
    ("error", T.StringType(), True),
    ("updated_at", T.TimestampType(), False),
)

# ``price_text`` keeps the price as it was written, which is what exports show.
PRODUCT_SCHEMA = _struct(
    ("sku", T.StringType(), False),
    ("item_numbers", STRINGS, True),
    ("mfr_numbers", STRINGS, True),
    ("name", T.StringType(), False),
    ("product_url", T.StringType(), False),
    ("category_path", STRINGS, True),
    ("brand", T.StringType(), True),
    ("price", PRICE, True),
    ("price_text", T.StringType(), True),
    ("currency", T.StringType(), True),
    ("availability", T.StringType(), True),
    ("pack_size", T.StringType(), True),
    ("description", T.StringType(), True),
    ("specifications", STRING_MAP, True),
    ("image_urls", STRINGS, True),
    ("alternative_products", STRINGS, True),
    ("extracted_at", T.TimestampType(), False),
    ("extraction_method", T.StringType(), False),
    ("source_category", T.StringType(), True),
)

# A fallback answer: what a model replied for one page, all fields optional.
ANSWER_SCHEMA = _struct(
    ("sku", T.StringType(), True),
    ("item_numbers", STRINGS, True),
    ("mfr_numbers", STRINGS, True),
    ("name", T.StringType(), True),
    ("brand", T.StringType(), True),
    ("price", T.StringType(), True),
    ("currency", T.StringType(), True),
    ("availability", T.StringType(), True),
    ("pack_size", T.StringType(), True),
    ("description", T.StringType(), True),
    ("specifications", STRING_MAP, True),
    ("image_urls", STRINGS, True),
    ("alternative_products", STRINGS, True),
    ("category_path", STRINGS, True),
)

# One reply of the listing search, as far as the listing reader needs it.
LISTING_REPLY_SCHEMA = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "hits",
                            T.ArrayType(T.StructType([T.StructField("url", T.StringType())])),
                        ),
                        T.StructField("nbPages", T.LongType()),
                    ]
                )
            ),
        )
    ]
)
