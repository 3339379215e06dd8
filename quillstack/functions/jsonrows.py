"""Rows of loosely structured JSON as passages.

A value is looked up under several names, at the top first and then under
``metadata``; the first name with a value that isn't null decides, even if the
value is of no use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

#: Names that a passage's fields go by, in the order of preference (fixed values).
TEXT_NAMES = ("text", "content", "page_content", "raw_text")
INDEX_NAMES = ("chunk_index", "chunk_id", "id")
HEADING_NAMES = ("headings", "heading", "section", "title")
PAGE_NAMES = ("page_numbers", "page_number", "page_no", "page")


def _paths(names: tuple[str, ...]) -> list[str]:
    return [f"$.{n}" for n in names] + [f"$.metadata.{n}" for n in names]


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def first_value(v: Column, names: tuple[str, ...]) -> Column:
    """The first value that is there and not null, whatever it is."""
    at = lambda p: F.try_variant_get(v, p, "variant")
    return F.coalesce(*(F.when(~F.is_variant_null(at(p)), at(p)) for p in _paths(names)))


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def row_text(v: Column) -> Column:
    """The first string that isn't blank, trimmed."""
    at = lambda p: trim_space(_string(F.try_variant_get(v, p, "variant")))
    return F.coalesce(*(F.when(at(p) != "", at(p)) for p in _paths(TEXT_NAMES)))


def row_index(v: Column, line: Column) -> Column:
    """An integer, or a string that is one; else the number of the line."""
    found = first_value(v, INDEX_NAMES)
    integer = F.when(_kind(found) == "BIGINT", F.try_variant_get(found, "$", "bigint"))
    written = F.when(F.rlike(_string(found), F.lit(r"^[+-]?\d+$")), _string(found).try_cast("bigint"))
    return F.coalesce(integer, written, line.cast("bigint"))


def _elements(v: Column) -> Column:
    """A value as an array of variants: the elements of an array, or the value alone."""
    return F.coalesce(F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.array(v))


def row_headings(v: Column) -> Column:
    """A string, or the strings of an array, trimmed; blank ones left out."""
    found = first_value(v, HEADING_NAMES)
    single = F.when(_kind(found) == "STRING", F.filter(F.array(trim_space(_string(found))), lambda x: x != ""))
    several = F.when(_kind(found).startswith("ARRAY"), F.filter(F.transform(_elements(found), lambda x: trim_space(_string(x))), lambda x: x.isNotNull() & (x != "")))
    return F.coalesce(single, several, F.array().cast("array<string>"))


def row_pages(v: Column) -> Column:
    """Whole numbers from 0 to 2^32 - 1, or strings of them; sorted, each once."""
    found = first_value(v, PAGE_NAMES)

    def page(x: Column) -> Column:
        number = F.coalesce(F.when(_kind(x) == "BIGINT", F.try_variant_get(x, "$", "bigint")), F.when(F.rlike(_string(x), F.lit(r"^\+?\d+$")), _string(x).try_cast("bigint")))
        return F.when(number.between(0, (1 << 32) - 1), number)

    pages = F.filter(F.transform(_elements(found), page), lambda x: x.isNotNull())
    return F.coalesce(F.when(found.isNotNull(), F.array_sort(F.array_distinct(pages))), F.array().cast("array<bigint>"))


def passage(json: Column, line: Column) -> Column:
    """struct(status, chunk_index, text, headings, pages) of one line.

    status is ``ok``, ``blank`` (nothing on the line), ``malformed`` (no JSON) or
    ``skipped`` (no object, or no text in it).
    """
    v = F.try_parse_json(json)
    text = row_text(v)
    status = F.when(trim_space(json) == "", "blank").when(v.isNull(), "malformed").when(~_kind(v).startswith("OBJECT") | text.isNull(), "skipped").otherwise("ok")
    return F.struct(status.alias("status"), row_index(v, line).alias("chunk_index"), text.alias("text"), row_headings(v).alias("headings"), row_pages(v).alias("pages"))
