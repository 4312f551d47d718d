"""An invented annual report of three pages, as the parsers would give it: for trying things out without any PDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from docmetrics.sources.pages import PAGE

COMPANY, YEAR = "Sample Works Ltd", 2023
INCOME = [("Revenue", "50,000"), ("Cost of goods", "(31,500)"), ("Operating Income", "12,000"), ("Net Income", "9,000"), ("Earnings Per Share (Diluted)", "4.50")]
BALANCE = [("Total Assets", "120,000"), ("Total Liabilities", "70,000"), ("Cash and Cash Equivalents", "15,000")]


def sample_pages() -> list[dict]:
    """The pages as a parser gives them: a cover, an income statement and a balance sheet, the last two with a table."""
    cover = f"{COMPANY}\nAnnual Report {YEAR}\nAmounts in millions of US dollars but for amounts per share"
    out = [{"page_number": 1, "text": cover, "tables": []}]
    for n, (title, rows) in enumerate((("Consolidated Statements of Operations", INCOME), ("Consolidated Balance Sheets", BALANCE)), 2):
        text = "\n".join([title, *(part for row in rows for part in row)])
        out.append({"page_number": n, "text": text, "tables": [{"rows": [["Item", str(YEAR)], *map(list, rows)], "bbox": [50.0, 100.0, 550.0, 120.0 + 20 * len(rows)], "table_index": 0}]})
    for page in out:
        lines = page["text"].split("\n")
        page["blocks"] = [{"text": line, "bbox": [50.0, 40.0 + 14 * i, 550.0, 52.0 + 14 * i], "block_index": i, "font_size": 12.0} for i, line in enumerate(lines)]
        page |= {"width": 612.0, "height": 792.0}
    return out


def sample_parsed(spark: SparkSession) -> DataFrame:
    """One row per page, as :func:`docmetrics.sources.pages.parse` gives them."""
    names = ["page_number", "text", "width", "height", "blocks", "tables"]
    rows = [("sample", None, *[p[k] for k in names]) for p in sample_pages()]
    return spark.createDataFrame(rows, f"document_id string, error string, {PAGE}")


def sample_document(spark: SparkSession) -> DataFrame:
    """(document_id, company, fiscal_year) of the sample."""
    schema = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("company", T.StringType()), T.StructField("fiscal_year", T.IntegerType())])
    return spark.createDataFrame([("sample", COMPANY, YEAR)], schema)


