"""Exports of the products table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# The columns of an export, in file order.
EXPORT_COLUMNS = (
    "sku",
    "item_numbers",
    "mfr_numbers",
    "name",
    "product_url",
    "category_path",
    "brand",
    "price",
    "currency",
    "availability",
    "pack_size",
    "description",
    "specifications",
    "image_urls",
    "alternative_products",
    "extracted_at",
    "extraction_method",
    "source_category",
)
CSV_NAMES = {"specifications": "specifications_json"}
LIST_SEPARATOR = "|"
PATH_SEPARATOR = " > "
FORMATS = {"csv": ("csv",), "json": ("json",), "both": ("csv", "json")}


def iso_time(c: Column) -> Column:
    """ISO text with offset; the fraction is shown only when there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fraction = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.date_trunc("second", c) == c, whole).otherwise(fraction)


def json_row() -> list[Column]:
    """Products as JSON fields: price as the text it had, times as ISO text."""
    texts = {"price": F.col("price_text"), "extracted_at": iso_time(F.col("extracted_at"))}
    return [texts.get(name, F.col(name)).alias(name) for name in EXPORT_COLUMNS]


def csv_row() -> list[Column]:
    """Products as flat text: lists joined, specifications as JSON, NULL as empty text."""
    flat = {
        "category_path": F.array_join("category_path", PATH_SEPARATOR),
        "specifications": F.to_json("specifications"),
        "price": F.col("price_text"),
        "extracted_at": iso_time(F.col("extracted_at")),
    }
    for name in ("item_numbers", "mfr_numbers", "image_urls", "alternative_products"):
        flat[name] = F.array_join(name, LIST_SEPARATOR)
    return [
        F.coalesce(flat.get(name, F.col(name)), F.lit("")).alias(CSV_NAMES.get(name, name)) for name in EXPORT_COLUMNS
    ]


def _write_counted(rows: DataFrame, write) -> int:
    """Write and count in the same pass."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def json_lines(products: DataFrame) -> DataFrame:
    """One JSON text per product in SKU order; NULL fields are written."""
    return products.orderBy("sku").select(
        F.to_json(F.struct(*json_row()), {"ignoreNullFields": "false"}).alias("value")
    )


def export_json(products: DataFrame, path: str) -> int:
    """Write JSON Lines files in SKU order, replacing what is there; returns the row count."""
    return _write_counted(json_lines(products), lambda rows: rows.write.mode("overwrite").text(path))


def export_csv(products: DataFrame, path: str) -> int:
    """Write CSV files with header in SKU order, replacing what is there; returns the row count."""

    def write(rows: DataFrame) -> None:
        options = {"header": "true", "escape": '"', "emptyValue": ""}
        # values are written as they are, with the white space at their ends
        options |= {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        rows.write.mode("overwrite").options(**options).csv(path)

    return _write_counted(products.orderBy("sku").select(*csv_row()), write)


def export(products: DataFrame, out: str, fmt: str = "both") -> dict[str, str]:
    """Write ``csv``, ``json`` or ``both`` below ``out``; returns path -> "n rows"."""
    if fmt not in FORMATS:
        raise ValueError(f"fmt is one of {', '.join(FORMATS)}")
    writers = {"csv": export_csv, "json": export_json}
    paths = {f"{out.rstrip('/')}/products.{kind}": writers[kind] for kind in FORMATS[fmt]}
    return {path: f"{write(products, path)} rows" for path, write in paths.items()}
