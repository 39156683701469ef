"""The pages of a text inside its row: from marker lines, or from form feeds where a text has no markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

# Fixed value: a line that starts a page and gives its number.
MARKER = r"(?md)^\[\[page\s+(\d+)\]\]\s*$"


def mark_pages(text: Column) -> Column:
    """The text with marker lines. Form feeds count as page ends where it has none; blank pages are left out, but numbered."""
    parts = F.transform(F.split(text, "\f"), lambda p, i: F.when(
        F.regexp_replace(p, r"(?U)\s+", "") != "", F.concat(F.lit("[[page "), (i + 1).cast("string"), F.lit("]]\n"), p, F.lit("\n"))))
    return F.when(F.contains(text, F.lit("\f")) & ~text.rlike(MARKER), F.array_join(F.array_compact(parts), "")).otherwise(text)


def _marks_and_bodies(marked: Column) -> Column:
    """``array<struct<mark, body>>`` of a marked text: each marker line and what follows it."""
    bodies = bound(F.split(marked, MARKER), lambda p: F.slice(p, F.lit(2), F.size(p)))
    return F.zip_with(F.regexp_extract_all(marked, F.lit(MARKER), F.lit(0)), bodies, lambda m, b: F.struct(m.alias("mark"), b.alias("body")))


def _number(mark: Column) -> Column:
    return F.regexp_extract(mark, MARKER, 1).cast("int")


def numbered_pages(text: Column) -> Column:
    """``array<struct<page, text>>`` of the text, in order: as ``page_map``, without places and in one pass."""
    return F.transform(bound(mark_pages(text), _marks_and_bodies), lambda x: F.struct(_number(x["mark"]).alias("page"), x["body"].alias("text")))


def first_pages(text: Column) -> Column:
    """``numbered_pages``, by number; of a number that stands twice the first page counts."""
    ranked = F.sort_array(F.transform(numbered_pages(text), lambda p, i: F.struct(p["page"].alias("page"), i.alias("i"), p["text"].alias("text"))))
    return bound(ranked, lambda r: F.filter(r, lambda p, i: (i == 0) | ~F.get(r, i - 1)["page"].eqNullSafe(p["page"])))


def page_map(text: Column) -> Column:
    """``array<struct<page, begin, text>>`` of the marked text: page number, place of its first character (from 1) and text, in order.

    What stands before the first marker belongs to no page. A text without markers or form feeds has no pages."""
    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["mark"])
        return F.struct((begin + F.length(x["body"])).cast("int").alias("at"), F.concat(acc["out"], F.array(begin.cast("int"))).alias("out"))

    def placed(marked: Column) -> Column:
        zero = F.struct((F.length(F.get(F.split(marked, MARKER), F.lit(0))) + 1).cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return bound(_marks_and_bodies(marked), lambda xs: F.zip_with(
            xs, F.reduce(xs, zero, step, lambda acc: acc["out"]),
            lambda x, begin: F.struct(_number(x["mark"]).alias("page"), begin.alias("begin"), x["body"].alias("text"))))

    return bound(mark_pages(text), placed)


def page_texts(text: Column) -> Column:
    """The texts of the pages; a text without pages is one page."""
    pages = F.transform(numbered_pages(text), lambda p: p["text"])
    return F.when(F.size(pages) > 0, pages).otherwise(F.array(text))


def page_at(pages: Column, place: Column) -> Column:
    """Number of the page that holds the character at ``place`` of the marked text; NULL before the first page."""
    before = F.filter(pages, lambda p: p["begin"] <= place)
    return F.get(before, F.size(before) - 1)["page"]
