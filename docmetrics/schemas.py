"""Names, limits and schemas shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The seven numbers of a report, the ways of choosing a model's context, keywords of statements, lengths in code points.
METRICS = ["revenue", "net_income", "operating_income", "total_assets", "total_liabilities", "cash_and_equivalents", "eps"]
PIPELINES = ["text_only", "layout_aware", "hybrid"]
INCOME_WORDS = ["revenue", "net income", "operating income", "net sales", "consolidated statements of operations", "statements of earnings"]
BALANCE_WORDS = ["total assets", "total liabilities", "cash and cash equivalents", "consolidated balance sheets"]
MAX_CONTEXT = 12_000
MAX_SOURCE_TEXT = 2_000


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "timestamp_ntz": T.TimestampNTZType(), "array<double>": T.ArrayType(T.DoubleType())}


def _struct(columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, columns.split(", "))])


_NUMBERS = ", ".join(f"{m} double" for m in METRICS)
GROUND_TRUTH = _struct(f"company string, fiscal_year int, {_NUMBERS}, currency string, unit string, source string")
#: The stored tables and what identifies a row of each.
TABLES = {
    "documents": _struct("document_id string, company string, fiscal_year int, filename string, file_path string, file_size_bytes bigint, page_count int, doc_type string, source_url string, status string, ingested_at timestamp_ntz"),
    "extractions": _struct("extraction_id string, document_id string, pipeline string, validation_status string, result_json string, created_at timestamp_ntz"),
    "metrics": _struct("extraction_id string, field_name string, value double, original_value string, unit string, currency string, page int, source_text string, bbox_json string, confidence double"),
    "provenance": _struct("extraction_id string, document_id string, field_name string, page int, source_text string, bbox array<double>, confidence double, input_tokens bigint, output_tokens bigint, estimated_cost_usd double"),
    "evaluations": _struct("document_id string, pipeline string, experiment_id string, field_comparisons_json string, created_at timestamp_ntz"),
    "failures": _struct("extraction_id string, document_id string, pipeline string, field_name string, failure_type string, severity string, root_cause string, predicted double, expected double"),
    "experiments": _struct("experiment_id string, pipeline string, dataset string, llm_provider string, llm_model string, document_count bigint, status string, started_at timestamp_ntz"),
}
KEYS = {
    "documents": ["document_id"], "extractions": ["extraction_id"], "metrics": ["extraction_id", "field_name"], "provenance": ["extraction_id", "field_name"],
    "evaluations": ["document_id", "pipeline", "experiment_id"], "failures": ["extraction_id", "field_name"], "experiments": ["experiment_id"],
}
