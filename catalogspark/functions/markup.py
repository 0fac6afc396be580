"""Fields that only the markup of a page shows: pack size, specification table, related products.

Nesting cannot be read by a pattern, so this is an Arrow-batched function on the standard library's
HTML parser. Pages without any of the class names looked for never reach it. Pages in plain markup, of which
every reading is the same, are cut into tags by one pattern; all others go through the parser.
"""

from __future__ import annotations

import re
import sys
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogspark.schemas import STRING_MAP, STRINGS

# Workers get this module's Python functions with the query, whether or not they have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The class names and the attribute that mark the fields.
PACK_SIZE_CLASS = "product-pack-size"
PACK_SIZE_ATTRIBUTE = "data-pack-size"
SPEC_TABLE_CLASS = "additional-attributes-table"  # on any element
DATA_TABLE_CLASS = "data"  # on a table
RELATED_CLASSES = frozenset({"related-products", "upsell-products"})
ITEM_LIST_CLASS, ITEM_LINK_CLASS = "product-items", "product-item-link"
PRODUCT_LINK = "/product/"

CLASS_HINTS = (PACK_SIZE_CLASS, SPEC_TABLE_CLASS, *sorted(RELATED_CLASSES), ITEM_LINK_CLASS)
TAG_HINT = r"(?i)<table[^>]+\bdata\b|\sdata-pack-size"

# Elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# A table row or cell ends where the next one starts.
ENDS_OPEN = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

# Plain markup: texts, tags whose attribute values are quoted and hold no angle brackets, end tags, simple comments, the document type.
_WS, _NAME = r"[ \t\n\r\f]", r"[a-zA-Z][a-zA-Z0-9-]*"
PLAIN_TOKEN = re.compile(
    rf"""([^<]+)|<({_NAME})((?:{_WS}+{_NAME}(?:=(?:"[^"<>]*"|'[^'<>]*'))?)*){_WS}*(/?)>|</({_NAME}){_WS}*>|<!--[^->]+-->|<!(?i:doctype)[^<>]*>"""
)
PLAIN_ATTRIBUTE = re.compile(rf"""({_NAME})(?:=(?:"([^"]*)"|'([^']*)'))?""")
# What may name an attribute that is read.
READ_ATTRIBUTE = re.compile(r"(?i)class|href|data-pack-size")
# Elements that hold raw text; those whose text has no markup but references; those that parsers treat in different ways.
RAW_TEXT = {tag: re.compile(rf"\s*{tag}", re.IGNORECASE) for tag in ("script", "style")}
MARKUP_FREE = {tag: re.compile(rf"(?i)[^<&]*</{tag}>") for tag in ("title", "textarea")}
OTHER_TEXT = frozenset("iframe math noembed noframes noscript plaintext svg xmp".split())

ENRICHMENT_SCHEMA = T.StructType(
    [
        T.StructField("pack_size", T.StringType()),
        T.StructField("specifications", STRING_MAP),
        T.StructField("alternative_products", STRINGS),
    ]
)
ENRICHMENT_TYPE = pa.struct(
    [
        ("pack_size", pa.string()),
        ("specifications", pa.map_(pa.string(), pa.string())),
        ("alternative_products", pa.list_(pa.string())),
    ]
)


class _Element:
    __slots__ = ("tag", "attrs", "words", "classes", "is_spec_row", "cells")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.words = tag, attrs, []
        self.classes = frozenset((attrs.get("class") or "").split())
        self.is_spec_row = False
        self.cells: dict[str, _Element] = {}

    def text(self) -> str:
        return "".join(self.words)


class _FieldReader(HTMLParser):
    """One pass over a page; text is kept only for elements that become a field."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Element] = []
        self.reading: list[_Element] = []
        self.by_class: _Element | None = None
        self.by_attribute: _Element | None = None
        self.rows: list[_Element] = []
        self.related: list[str] = []

    def feed_plain(self, page: str) -> bool:
        """Read a page of plain markup as ``feed`` and ``close`` would; False, with the reader spoiled, if it is any other."""
        at, end, token = 0, len(page), PLAIN_TOKEN.match
        while at < end:
            found = token(page, at)
            if found is None:
                return False
            text, tag, attributes, empty, closed = found.groups()
            at = found.end()
            if text:
                if self.reading:
                    self.handle_data(unescape(text))
            elif closed:
                self.handle_endtag(closed.lower())
            elif tag:
                tag, attrs = tag.lower(), []
                if attributes and READ_ATTRIBUTE.search(attributes):
                    if "&" in attributes:
                        return False
                    attrs = [(m[1].lower(), m[2] if m[3] is None else m[3]) for m in PLAIN_ATTRIBUTE.finditer(attributes)]
                if tag in OTHER_TEXT or (tag in MARKUP_FREE and not (empty or MARKUP_FREE[tag].match(page, at))):
                    return False
                self.handle_starttag(tag, attrs)
                if empty:
                    self.handle_endtag(tag)
                elif tag in RAW_TEXT:
                    stop = page.find("</", at)
                    while stop >= 0 and not RAW_TEXT[tag].match(page, stop + 2):
                        stop = page.find("</", stop + 2)
                    after = stop + len(tag) + 3
                    if stop < 0 or page[stop:after].lower() != f"</{tag}>":
                        return False
                    raw, at = page[at:stop], after
                    if "<!--" in raw or (self.reading and "<" in raw):
                        return False
                    if raw:
                        self.handle_data(raw)
                    self.handle_endtag(tag)
        return True

    def handle_starttag(self, tag, attrs):
        while self.open and self.open[-1].tag in ENDS_OPEN.get(tag, ()):
            self._close(len(self.open) - 1)
        element = _Element(tag, dict(attrs))
        if self.by_class is None and PACK_SIZE_CLASS in element.classes:
            self.by_class = element
            self.reading.append(element)
        if self.by_attribute is None and PACK_SIZE_ATTRIBUTE in element.attrs:
            self.by_attribute = element
            self.reading.append(element)
        if tag == "tr" and self._in_spec_table():
            element.is_spec_row = True
            self.rows.append(element)
        if tag in ("th", "td"):
            for row in self.open:
                if row.is_spec_row and tag not in row.cells:
                    row.cells[tag] = element
                    self.reading.append(element)
        if tag == "a" and self._is_related(element):
            self.related.append(element.attrs["href"])
        if tag not in VOID:
            self.open.append(element)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return

    def handle_data(self, data):
        for element in self.reading:
            element.words.append(data.strip())

    def _close(self, depth: int) -> None:
        closed = self.open[depth:]
        del self.open[depth:]
        if self.reading:
            self.reading = [e for e in self.reading if e not in closed]

    def _in_spec_table(self) -> bool:
        return any(
            SPEC_TABLE_CLASS in e.classes or (e.tag == "table" and DATA_TABLE_CLASS in e.classes) for e in self.open
        )

    def _is_related(self, link: _Element) -> bool:
        if PRODUCT_LINK not in (link.attrs.get("href") or ""):
            return False
        return any(
            e.classes & RELATED_CLASSES or (ITEM_LIST_CLASS in e.classes and ITEM_LINK_CLASS in link.classes)
            for e in self.open
        )


def read_fields(page: str) -> dict:
    reader = _FieldReader()
    if not reader.feed_plain(page):
        reader = _FieldReader()
        reader.feed(page)
        reader.close()
    return _fields_of(reader)


def _fields_of(reader: _FieldReader) -> dict:
    sizes = [e.text() for e in (reader.by_class, reader.by_attribute) if e is not None]
    specs = {r.cells["th"].text(): r.cells["td"].text() for r in reader.rows if len(r.cells) == 2}
    return {
        "pack_size": next((s for s in sizes if s), None),
        "specifications": list(specs.items()) or None,
        "alternative_products": list(dict.fromkeys(reader.related)) or None,
    }


@F.arrow_udf(ENRICHMENT_SCHEMA)
def _read_fields(pages: pa.Array) -> pa.Array:
    fields = [None if page is None else read_fields(page) for page in pages.to_pylist()]
    return pa.array(fields, type=ENRICHMENT_TYPE)


def markup_candidate(html: Column) -> Column:
    """The page if it may hold one of the fields, else NULL."""
    hinted = html.rlike(TAG_HINT)
    for name in CLASS_HINTS:
        hinted = F.contains(html, F.lit(name)) | hinted
    return F.when(hinted, html)


def dom_enrichments(candidate: Column) -> Column:
    """Struct of the three fields, each NULL when the page does not show it."""
    return _read_fields(candidate)
