"""The part of a document that a model is shown, one text per document and pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docmetrics.functions.tables import table_text
from docmetrics.functions.text import contains_any, head, strip
from docmetrics.schemas import BALANCE_WORDS, INCOME_WORDS, MAX_CONTEXT

WORDS = INCOME_WORDS + BALANCE_WORDS
BREAK = "\n\n--- PAGE BREAK ---\n\n"
#: Code points of a page shown with a table of layout_aware, with the first table of hybrid, and by itself.
HEADER, BESIDE, ALONE = 300, 1500, 2000


def is_relevant(text: Column) -> Column:
    """Whether a text has a keyword of the income statement or balance sheet."""
    return contains_any(text, WORDS)


def latest_pages(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, text): of a page delivered several times the one with the highest page_id; a null text is empty.

    Rows without document or page number are left out.
    """
    kept = pages.where("document_id IS NOT NULL AND page_number IS NOT NULL")
    return kept.groupBy("document_id", "page_number").agg(F.max_by("full_text", "page_id").alias("_t")).select("document_id", "page_number", F.coalesce("_t", F.lit("")).alias("text"))


def all_text(pages: DataFrame) -> DataFrame:
    """(document_id, text): the texts of all pages in order, a line break between them."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def keyword_pages(pages: DataFrame) -> DataFrame:
    """(document_id, page_number) of the pages with a keyword."""
    return pages.where(is_relevant(F.col("text"))).select("document_id", "page_number")


def text_context(pages: DataFrame) -> DataFrame:
    """(document_id, context): the pages with keywords, or all pages if none has any, joined by page breaks, the first 12,000 code points.

    A page that begins beyond the limit never leaves its task: one shuffle by document serves the running lengths and the collecting.
    """
    x = pages.select("document_id", "page_number", head(F.col("text"), MAX_CONTEXT).alias("text"), is_relevant(F.col("text")).alias("hit"), F.length("text").alias("_n"))
    order = Window.partitionBy("document_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.col("_n") + len(BREAK)
    x = x.withColumns({"_all": F.sum(length).over(order) - length, "_hit": F.sum(F.when(F.col("hit"), length).otherwise(0)).over(order) - F.when(F.col("hit"), length).otherwise(0)})
    x = x.where((F.col("_all") < MAX_CONTEXT) | F.col("hit") & (F.col("_hit") < MAX_CONTEXT))
    part = F.struct("page_number", "text")

    def joined(parts: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), BREAK)

    lists = x.groupBy("document_id").agg(F.collect_list(F.when(F.col("hit"), part)).alias("h"), F.collect_list(F.when(F.col("_all") < MAX_CONTEXT, part)).alias("a"))
    return lists.select("document_id", head(F.when(F.size("h") > 0, joined(F.col("h"))).otherwise(joined(F.col("a"))), MAX_CONTEXT).alias("context"))


def matching_tables(tables: DataFrame) -> DataFrame:
    """(document_id, page_number, table_index, text) of the tables with a keyword, as text between bars."""
    x = tables.where("document_id IS NOT NULL AND page IS NOT NULL").select("document_id", F.col("page").alias("page_number"), "table_index", table_text(F.col("rows")).alias("text"))
    return x.where(is_relevant(F.col("text")))


def _with_fallback(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """Join each document's (at, text) parts in order; documents without any have their text context."""
    order = Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length("text") + 2
    kept = parts.withColumn("_before", F.sum(length).over(order) - length).where(F.col("_before") < MAX_CONTEXT)
    cut_off = kept.select("document_id", "at", head(F.col("text"), MAX_CONTEXT).alias("text"))
    own = cut_off.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("_p"))
    own = own.select("document_id", head(F.array_join(F.transform("_p", lambda p: p["text"]), "\n\n"), MAX_CONTEXT).alias("_own"))
    return text_context(pages).join(own, "document_id", "left").select("document_id", F.coalesce("_own", "context").alias("context"))


def _at(*place: Column | int) -> Column:
    return F.array(*[(F.lit(p) if isinstance(p, int) else p).cast("bigint") for p in place]).alias("at")


def layout_context(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, context): every table with a keyword, before it the beginning of its page unless that is blank.

    The page's beginning is repeated for each of its tables.  Documents without such a table have their text context.
    """
    hits = matching_tables(tables)
    beside = hits.select("document_id", "page_number", "table_index").join(pages, ["document_id", "page_number"])
    begin = head(F.col("text"), HEADER)
    heads = beside.where(strip(begin) != "").select("document_id", _at(F.col("page_number"), F.col("table_index"), 0), F.concat(F.lit("[Page "), "page_number", F.lit(" context]\n"), begin).alias("text"))
    grids = hits.select("document_id", _at(F.col("page_number"), F.col("table_index"), 1), _titled(F.col("page_number"), F.col("text")))
    return _with_fallback(heads.unionByName(grids), pages)


def _titled(page: Column, text: Column) -> Column:
    return F.concat(F.lit("[Table on page "), page, F.lit("]\n"), text).alias("text")


def hybrid_context(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(document_id, context): tables with a keyword, before the first one of each page more of its text; then the other pages with keywords."""
    hits = matching_tables(tables)
    shown = hits.groupBy("document_id", "page_number").agg(F.min("table_index").alias("first"))
    beside = shown.join(pages, ["document_id", "page_number"])
    heads = beside.select("document_id", _at(0, F.col("page_number"), F.col("first"), 0), F.concat(F.lit("[Page "), "page_number", F.lit(" — full text]\n"), head(F.col("text"), BESIDE)).alias("text"))
    grids = hits.select("document_id", _at(0, F.col("page_number"), F.col("table_index"), 1), _titled(F.col("page_number"), F.col("text")))
    others = pages.where(is_relevant(F.col("text"))).join(shown, ["document_id", "page_number"], "left_anti")
    rest = others.select("document_id", _at(1, F.col("page_number"), 0, 0), F.concat(F.lit("[Page "), "page_number", F.lit("]\n"), head(F.col("text"), ALONE)).alias("text"))
    return _with_fallback(heads.unionByName(grids).unionByName(rest), pages)


def contexts(pages: DataFrame, tables: DataFrame, pipelines: list[str]) -> DataFrame:
    """(document_id, pipeline, context) of every document for each pipeline."""
    make = {"text_only": lambda: text_context(pages), "layout_aware": lambda: layout_context(pages, tables), "hybrid": lambda: hybrid_context(pages, tables)}
    if unknown := set(pipelines) - set(make):
        raise ValueError(f"unknown pipelines: {', '.join(sorted(unknown))}")
    out = None
    for p in pipelines:
        part = make[p]().select("document_id", F.lit(p).alias("pipeline"), "context")
        out = part if out is None else out.unionByName(part)
    return out
