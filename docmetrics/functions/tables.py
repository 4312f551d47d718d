"""Functions on table grids (arrays of rows of cells)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docmetrics.functions.normalize import NUMBER
from docmetrics.functions.text import strip


def filled(rows: Column) -> Column:
    """The grid with empty texts for null cells and empty rows for null rows."""
    empty = F.array().cast("array<string>")
    return F.transform(rows, lambda r: F.coalesce(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), empty))


def table_text(rows: Column) -> Column:
    """A grid as text: each row between bars on a line of its own; null or empty grids give an empty text."""
    lines = F.transform(filled(rows), lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def cell_text(rows: Column) -> Column:
    """All cells of a grid in one line, separated by spaces."""
    return F.coalesce(F.array_join(F.flatten(filled(rows)), " "), F.lit(""))


def is_numeric_cell(cell: Column) -> Column:
    """Whether a cell holds a number, once signs of currencies, commas, spaces, percent signs and brackets are gone; one minus in front is allowed."""
    bare = F.regexp_replace(F.regexp_replace(strip(cell), r"(?U)[\$€£¥,\s%()]", ""), r"^-", "")
    return F.coalesce(bare.rlike(NUMBER), F.lit(False))


def looks_like_header(row: Column) -> Column:
    """Whether fewer than half of the filled cells of a row are numbers; a row without filled cells isn't a header."""
    full = F.filter(row, lambda c: strip(F.coalesce(c, F.lit(""))) != "")
    return F.coalesce((F.size(full) > 0) & (F.size(F.filter(full, is_numeric_cell)) * 2 < F.size(full)), F.lit(False))


def header_row(rows: Column) -> Column:
    """The first row if it looks like a header, else an empty array."""
    first = F.get(filled(rows), F.lit(0))
    return F.when(looks_like_header(first), first).otherwise(F.array().cast("array<string>"))


def top_left(bbox: Column, page_height: Column) -> Column:
    """A box (left, top, right, bottom) measured from the bottom of the page, measured from its top instead.

    Without a height the box stays as it is; null stays null.
    """
    at = [F.get(bbox, F.lit(i)) for i in range(4)]
    turned = F.array(at[0], page_height - at[1], at[2], page_height - at[3])
    return F.when(page_height.isNull(), bbox).otherwise(F.when(bbox.isNotNull(), turned))
