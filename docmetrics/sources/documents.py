"""Document files: content ids, metadata from names, idempotent ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What is taken out of a file name before it counts as a company, in this order, and the ends that are trimmed.
SUFFIXES, ENDS = ["10k", "10K", "AR", "annual", "report", "filing"], "_- "
YEAR = r"(?:FY|fy)?(\b20[0-9]{2}\b)"


def content_id(content: Column) -> Column:
    """The first 32 hexadecimal digits of the SHA-256 of a document's bytes."""
    return F.substring(F.sha2(content, 256), 1, 32)


def file_stem(name: Column) -> Column:
    """A file name without its folders and its last extension; a leading dot is part of the stem."""
    return F.regexp_replace(F.regexp_extract(name, r"[^/\\]*$", 0), r"(?<=.)\.[^.]*$", "")


def name_year(name: Column) -> Column:
    """The year from 2000 to 2099 in a file name, as a word of its own (not beside a letter, digit or underscore); else null."""
    return F.regexp_extract(file_stem(name), YEAR, 1).try_cast("int")


def name_company(name: Column) -> Column:
    """The company in a file name: what stands before the year, or all of it, without the usual suffixes wherever they stand; null if nothing is left."""
    stem = file_stem(name)
    at = F.regexp_instr(stem, F.lit(YEAR))
    left = F.when(at > 0, F.btrim(F.substr(stem, F.lit(1), at - 1), F.lit(ENDS))).otherwise(stem)
    for s in SUFFIXES:
        left = F.btrim(F.replace(left, F.lit(s), F.lit("")), F.lit(ENDS))
    return F.nullif(left, F.lit(""))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, content, file_size_bytes) of the PDF files in a folder, extension in any case; other files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = raw.select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("filename"), "content", F.col("length").alias("file_size_bytes"))
    return named.where(F.lower("filename").endswith(".pdf"))


def with_overrides(files: DataFrame, overrides: DataFrame) -> DataFrame:
    """files with company and fiscal_year: those of ``overrides`` (filename, company, fiscal_year), else from the name, else Unknown and 0."""
    given = overrides.where("filename IS NOT NULL").groupBy("filename").agg(F.max("company").alias("_c"), F.max("fiscal_year").alias("_y"))
    out = files.join(given, "filename", "left")
    company = F.coalesce(F.nullif("_c", F.lit("")), name_company(F.col("filename")), F.lit("Unknown"))
    year = F.coalesce(F.nullif("_y", F.lit(0)), name_year(F.col("filename")), F.lit(0))
    return out.withColumns({"company": company, "fiscal_year": year.cast("int")}).drop("_c", "_y")


def new_documents(files: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per document id that isn't in ``existing``: known documents keep the metadata they have.

    Of files with the same content the first by name counts.  Only ids of ``existing`` are read.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in files.columns])
    once = files.where("document_id IS NOT NULL").groupBy("document_id").agg(F.min_by(row, "filename").alias("r")).select("r.*")
    return once.join(existing.select("document_id"), "document_id", "left_anti")


def ingest(files: DataFrame, existing: DataFrame, overrides: DataFrame, doc_type: str = "annual_report") -> DataFrame:
    """The rows to append to the documents table for files with filename, content and file_size_bytes (and page_count, where that is known)."""
    pages = F.col("page_count").cast("int") if "page_count" in files.columns else F.lit(None).cast("int")
    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
    base = files.select(content_id(F.col("content")).alias("document_id"), "filename", path.alias("file_path"), "file_size_bytes", pages.alias("page_count"))
    named = with_overrides(new_documents(base, existing), overrides)
    return named.select("document_id", "company", "fiscal_year", "filename", "file_path", "file_size_bytes", "page_count", F.lit(doc_type).alias("doc_type"), F.lit(None).cast("string").alias("source_url"), F.lit("ingested").alias("status"), F.current_timestamp().cast("timestamp_ntz").alias("ingested_at"))
