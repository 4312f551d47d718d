"""Where in a document an extracted value stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docmetrics.functions.tables import cell_text
from docmetrics.functions.text import head, occurrences, snippet


def keyword_occurrences(pages: DataFrame, word: str, around: int = 500, case_sensitive: bool = False) -> DataFrame:
    """(page_id, document_id, page_number, position, context): every place of a word in the page texts, overlapping ones too."""
    return pages.select("page_id", "document_id", "page_number", F.inline(occurrences(F.col("full_text"), word, around, case_sensitive)))


def value_sources(values: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """values with page, source_text and bbox: the first page whose text has the value's ``printed`` form, else one of whose blocks has it.

    ``values`` has a unique value_id, document_id and printed; ``pages`` are those of :func:`docmetrics.operators.context.latest_pages`.  Pages are tried in order, each page's text before its
    blocks.  Within a page the text around the place counts, 100 code points on either side; a block gives its first 500 and its box.  The joins are
    by document with the search as a condition, so that only hits leave them.  Values not found, null or empty, have nulls.
    """
    asked = values.where("document_id IS NOT NULL AND printed IS NOT NULL AND printed <> ''").select("value_id", "document_id", F.lower("printed").alias("_key"))
    on_page = asked.join(pages.select("document_id", "page_number", "text"), "document_id").where(F.contains(F.lower("text"), F.col("_key")))
    on_page = on_page.select("value_id", F.struct(F.col("page_number").cast("int").alias("page"), F.lit(0).alias("kind"), F.lit(0).alias("k")).alias("at"), snippet(F.col("text"), F.col("_key")).alias("source_text"), F.lit(None).cast("array<double>").alias("bbox"))
    known = pages.select("document_id", F.col("page_number").alias("page"))
    shown = blocks.join(known, ["document_id", "page"], "left_semi").select("document_id", F.col("page").alias("page_number"), "block_index", F.col("text").alias("_block"), "bbox")
    in_block = asked.join(shown, "document_id").where(F.contains(F.lower("_block"), F.col("_key")))
    in_block = in_block.select("value_id", F.struct(F.col("page_number").cast("int").alias("page"), F.lit(1).alias("kind"), F.col("block_index").cast("int").alias("k")).alias("at"), head(F.col("_block"), 500).alias("source_text"), "bbox")
    first = on_page.unionByName(in_block).groupBy("value_id").agg(F.min_by(F.struct(F.col("at.page").alias("page"), "source_text", "bbox"), F.struct("at", "source_text")).alias("s"))
    return values.join(first, "value_id", "left").select(*[F.col(f"`{c}`") for c in values.columns], F.col("s.page").alias("page"), F.col("s.source_text").alias("source_text"), F.col("s.bbox").alias("bbox"))


def first_table_with(tables: DataFrame, word: str, case_sensitive: bool = False) -> DataFrame:
    """(document_id, page, table_index, table_id): each document's first table whose cells contain the word."""
    text = cell_text(F.col("rows"))
    hit = F.contains(text, F.lit(word)) if case_sensitive else F.contains(F.lower(text), F.lit(word.lower()))
    found = tables.where(hit & F.col("document_id").isNotNull())
    return found.groupBy("document_id").agg(F.min(F.struct("page", "table_index", "table_id")).alias("t")).select("document_id", "t.*")


def provenance(metrics: DataFrame, calls: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, pipeline, field_name, page, source_text, bbox, confidence, input_tokens, output_tokens): one row per extracted field.

    What the metric itself states comes before what is found by its printed value (the original one, else the number).  Every row carries
    the tokens of its whole call.
    """
    some = metrics.where("value IS NOT NULL").withColumn("value_id", F.struct("document_id", "pipeline", "field_name")).withColumn("printed", F.coalesce(F.nullif("original_value", F.lit("")), F.col("value").cast("string")))
    some = some.select("value_id", "document_id", "pipeline", "field_name", "printed", F.col("source_text").alias("_stated"), "confidence")
    found = value_sources(some, pages, blocks)
    used = calls.select("document_id", "pipeline", "input_tokens", "output_tokens")
    return found.join(used, ["document_id", "pipeline"], "left").select("document_id", "pipeline", "field_name", "page", F.coalesce("_stated", "source_text").alias("source_text"), "bbox", "confidence", "input_tokens", "output_tokens")
