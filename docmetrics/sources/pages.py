"""Documents decoded into pages, blocks and tables by pluggable parsers.

A parser is a function from a document's bytes to a list of pages, each a dict of ``page_number``, ``text``, ``width``, ``height``,
``blocks`` (dicts of text, bbox, block_index, font_size) and ``tables`` (dicts of rows, bbox).  It runs inside of the workers, so
a library it needs must be installed there only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from docmetrics.functions.tables import filled, header_row
from docmetrics.session import once

Parser = Callable[[bytes, int | None], list[dict]]
PAGE = (
    "page_number int, text string, width double, height double, "
    "blocks array<struct<text: string, bbox: array<double>, block_index: int, font_size: double>>, "
    "tables array<struct<rows: array<array<string>>, bbox: array<double>, table_index: int>>"
)


def plain_text(content: bytes, max_pages: int | None = None) -> list[dict]:
    """Text with a form feed between pages; blank lines separate blocks.  No tables."""
    out = []
    for n, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        parts = [p.strip() for p in text.split("\n\n")]
        out.append({"page_number": n, "text": text, "blocks": [{"text": p, "block_index": i} for i, p in enumerate(parts) if p], "tables": []})
    return out[: max_pages or None]


def layout_free(content: bytes, max_pages: int | None = None) -> list[dict]:
    """PDF by pymupdf: text, blocks and ruled tables of every page.  A table that can't be read is left out."""
    import pymupdf

    out = []
    with pymupdf.open(stream=content, filetype="pdf") as pdf:
        for n, page in enumerate(pdf, 1):
            if max_pages and n > max_pages:
                break
            blocks = [{"text": t.strip(), "bbox": [float(v) for v in (x0, y0, x1, y1)], "block_index": i} for i, (x0, y0, x1, y1, t, _, kind) in enumerate(page.get_text("blocks")) if kind == 0 and t.strip()]
            tables = []
            for i, table in enumerate(page.find_tables().tables):
                try:
                    tables.append({"rows": table.extract(), "bbox": [float(v) for v in table.bbox], "table_index": i})
                except (RuntimeError, ValueError, IndexError):
                    continue
            out.append({"page_number": n, "text": page.get_text(), "width": page.rect.width, "height": page.rect.height, "blocks": blocks, "tables": tables})
    return out


def by_layout(content: bytes, max_pages: int | None = None) -> list[dict]:
    """PDF by docling: text items in reading order, then tables; only pages with content come out, boxes measured from the top."""
    import io

    from docling.datamodel.base_models import DocumentStream
    from docling.document_converter import DocumentConverter

    doc = DocumentConverter().convert(DocumentStream(name="document.pdf", stream=io.BytesIO(content))).document
    pages: dict[int, dict] = {}

    def place(item: object) -> tuple[dict, list[float] | None] | None:
        if not item.prov:
            return None
        at = item.prov[0]
        size = doc.pages[at.page_no].size if at.page_no in doc.pages else None
        page = pages.setdefault(at.page_no, {"page_number": at.page_no, "text": "", "width": size and size.width, "height": size and size.height, "blocks": [], "tables": []})
        box = at.bbox.to_top_left_origin(size.height) if at.bbox and size else at.bbox
        return page, [float(v) for v in (box.l, box.t, box.r, box.b)] if box else None

    for item in doc.texts:
        if (at := place(item)) and item.text.strip():
            at[0]["text"] += item.text + "\n"
            at[0]["blocks"].append({"text": item.text, "bbox": at[1], "block_index": len(at[0]["blocks"])})
    for item in doc.tables:
        if at := place(item):
            grid = [[cell.text or "" for cell in row] for row in item.data.grid]
            at[0]["tables"].append({"rows": grid, "bbox": at[1], "table_index": len(at[0]["tables"])})
    return sorted(pages.values(), key=lambda p: p["page_number"])[: max_pages or None]


PARSERS: dict[str, Parser] = {"text": layout_free, "docling": by_layout, "plain": plain_text}


def parse(files: DataFrame, parser: str | Parser = "text", max_pages: int | None = None) -> DataFrame:
    """(document_id, error, page struct columns): the pages of files (document_id, content); a document that can't be read has one row with its error.

    Unknown parser names mean ``text``; ``max_pages`` of 0 or None means all.
    """
    decode = parser if callable(parser) else PARSERS.get(parser, layout_free)
    names = ["page_number", "text", "width", "height", "blocks", "tables"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, content in zip(pdf["document_id"], pdf["content"]):
                try:
                    rows = [(doc, None, *[p.get(k) for k in names]) for p in decode(bytes(content), max_pages)]
                except Exception as e:  # noqa: BLE001 - whatever a parser raises is that document's error
                    rows = [(doc, f"{type(e).__name__}: {e}", *[None] * len(names))]
                for page in rows:
                    page[6] and [b.setdefault(k, None) for b in page[6] for k in ("bbox", "font_size")]
                yield pd.DataFrame(rows, columns=["document_id", "error", *names])

    return files.where("content IS NOT NULL").select("document_id", "content").mapInPandas(run, f"document_id string, error string, {PAGE}")


def page_rows(parsed: DataFrame) -> DataFrame:
    """(document_id, page_number, full_text, width, height)."""
    return parsed.where("error IS NULL").select("document_id", "page_number", F.col("text").alias("full_text"), "width", "height")


def block_rows(parsed: DataFrame) -> DataFrame:
    """(document_id, page, text, bbox, block_index, font_size)."""
    return parsed.select("document_id", F.col("page_number").alias("page"), F.inline("blocks"))


def table_rows(parsed: DataFrame) -> DataFrame:
    """(document_id, page, table_index, rows, headers, bbox): null cells as empty texts; empty tables are left out."""
    flat = parsed.select("document_id", F.col("page_number").alias("page"), F.inline("tables")).where(F.size("rows") > 0)
    return flat.select("document_id", "page", "table_index", filled(F.col("rows")).alias("rows"), header_row(F.col("rows")).alias("headers"), "bbox")


def numbered(items: DataFrame, page: str = "page", order: str = "block_index") -> DataFrame:
    """items with ``running``, their number on their page counted from 0 without gaps."""
    place = Window.partitionBy("document_id", page).orderBy(order)
    return items.withColumn("running", F.row_number().over(place) - 1)


def page_counts(parsed: DataFrame) -> DataFrame:
    """(document_id, pages, tables) of the readable documents."""
    return parsed.where("error IS NULL").groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce(F.size("tables"), F.lit(0))).alias("tables"))


def grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows): cells (keys, row, col, text; counted from 0) put into a full grid, empty where there is none; the last of several by text counts."""
    text = F.coalesce("text", F.lit("")).alias("text")
    cells = cells.where("row >= 0 AND col >= 0").groupBy(*keys).agg(F.max("row").alias("_r"), (F.max("col") + 1).alias("_w"), F.sort_array(F.collect_list(F.struct("row", "col", text))).alias("_c"))
    place = lambda c: c["row"].cast("bigint") * F.col("_w") + c["col"]
    end = (F.col("_r").cast("bigint") + 1) * F.col("_w")

    def filled_up(c: Column, i: Column) -> Column:
        """The cell and the gap before the next one; nothing for a cell that is followed by another at its place."""
        steps = (F.coalesce(place(F.get("_c", i + 1)), end) - place(c)).cast("int")
        return F.concat(F.array_repeat(c["text"], F.least(steps, F.lit(1))), F.array_repeat(F.lit(""), steps - 1))

    complete = (F.size("_c") == end) & F.forall(F.sequence(F.lit(0), F.size("_c") - 1), lambda i: place(F.get("_c", i)) == i)
    gaps = F.concat(F.array_repeat(F.lit(""), place(F.get("_c", F.lit(0))).cast("int")), F.flatten(F.transform("_c", filled_up)))
    # Made once a grid: merged with the next step, it would be made again for each row.
    line = once(cells, "_f", F.when(complete, F.col("_c.text")).otherwise(gaps))
    cut_out = lambda r: F.slice("_f", (r * F.col("_w") + 1).cast("int"), F.col("_w").cast("int"))
    return line.select(*keys, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_r").cast("bigint")), cut_out).alias("rows"))
