"""Queries of the core operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmetrics.functions import normalize, tables as grids, text
from docmetrics.operators import context, cost, evaluate, extract, metrics, provenance, ranks, units, validate
from docmetrics.plans import sql
from docmetrics.plans.experiment import Experiment
from docmetrics.session import table
from docmetrics.sources import csv_records, documents, pages
from docmetrics.sources.ground_truth import number_cell
from docmetrics.storage import matching, newest, run_rows, wide_reports
from docmetrics.streaming.ingest import call_windows

#: Prices that the cost queries use; any table of this form does.
PRICES = [("northlight-large", 0, 3.0, 12.0), ("northlight-mini-2", 1, 0.5, 2.0), ("corvid", 2, 1.0, 4.0), ("halcyon-base-2024", 3, 0.25, 1.0), ("mock-model-v1", 4, 0.0, 0.0)]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return csv_records.rejected(table(spark, d, "financial_metrics_raw"))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return csv_records.loaded(table(spark, d, "financial_metrics_raw"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return units.disagreements(p3_quantities(spark, d))


def p3_quantities(spark: SparkSession, d: str) -> DataFrame:
    return units.quantities(*(table(spark, d, t) for t in ("metric_records", "filings", "fx_rates")))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    """metric_records, each record once; what the extraction has is what its records say."""
    return table(spark, d, "metric_records").dropDuplicates(["metric_id"])


def _runs(spark: SparkSession, d: str) -> DataFrame:
    filed = table(spark, d, "filings").select("document_id", "company", "fiscal_year")
    return _metrics(spark, d).select(F.col("extraction_id").alias("run_id"), "document_id", "pipeline").distinct().join(filed, "document_id")


def _results(spark: SparkSession, d: str) -> DataFrame:
    found = _metrics(spark, d).select(F.col("extraction_id").alias("run_id"), "field_name", "value", "unit")
    return evaluate.field_results(_runs(spark, d), found, table(spark, d, "gt_records"))


def field_result(spark: SparkSession, d: str) -> DataFrame:
    cols = ["run_id", "field_name", "predicted", "ground_truth", "absolute_error", "relative_error", "exact_match", "within_05pct", "within_1pct", "within_5pct"]
    return _results(spark, d).select(*cols)


def failure_classify(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.failures(_results(spark, d)).select("run_id", "field_name", "failure_type")


def failure_severity(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.failures(_results(spark, d)).select("run_id", "field_name", "severity")


def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.failure_counts(evaluate.failures(_results(spark, d)))


def failures_filtered(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.failures(_results(spark, d))
    return matching(found, pipeline="hybrid", failure_type="UNIT_NORMALIZATION", document_id=None).select("run_id", "document_id", "field_name")


def per_field_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.field_accuracy(_results(spark, d), ["pipeline"])


def per_company_accuracy(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.accuracy(_results(spark, d).withColumn("company_key", evaluate.company_key(F.col("company"))), ["company_key"])
    return out.select("company_key", "total_fields", "extracted_fields", "accuracy_1pct", "accuracy_5pct")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Each call once; latencies that were measured."""
    calls = table(spark, d, "llm_calls").dropDuplicates(["call_id"])
    return calls.withColumn("latency_ms", F.when(~F.isnan("latency_ms") & (F.col("latency_ms") >= 0), F.col("latency_ms")))


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, cost.PRICES)


def pipeline_metrics(spark: SparkSession, d: str) -> DataFrame:
    calls = cost.call_costs(_calls(spark, d), _prices(spark)).join(table(spark, d, "experiments").select("experiment_id", "pipeline"), "experiment_id")
    runs = calls.select("pipeline", "latency_ms", "cost_usd", F.when(text.json_object(F.col("text")).isNull(), "invalid").alias("status"))
    out = metrics.pipeline_metrics(_results(spark, d), runs)
    rounded = [F.round(c, 6).alias(c) for c in ("mean_relative_error", "mean_latency_ms", "total_cost_usd", "cost_per_document_usd", "validation_failure_rate")]
    same = ["document_count", "total_fields", "extracted_fields", "missing_fields", "extraction_coverage", "exact_accuracy", "accuracy_05pct", "accuracy_1pct", "accuracy_5pct", "median_latency_ms", "p95_latency_ms", "min_latency_ms", "max_latency_ms"]
    return out.select("pipeline", *same, *rounded)


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return metrics.coverage(_metrics(spark, d), ["extraction_id"])


def accuracy_bars(spark: SparkSession, d: str) -> DataFrame:
    return metrics.accuracy_bars(metrics.accuracy(_results(spark, d), ["pipeline"]))


def failure_bars(spark: SparkSession, d: str) -> DataFrame:
    return metrics.failure_bars(evaluate.failures(_results(spark, d)))


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    out = ranks.latency_stats(_calls(spark, d), ["model"])
    return out.withColumn("mean", F.round("mean", 6))


def latency_windows(spark: SparkSession, d: str) -> DataFrame:
    return call_windows(table(spark, d, "llm_calls")).select("start", "model", "calls")


def normalize_value(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d).select("metric_id", F.explode(F.array(normalize.normalize_value(F.col("original_value")))).alias("n"))
    return m.select("metric_id", "n.value", "n.unit", "n.currency", "n.is_negative", "n.multiplier")


def normalize_errors(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d).select("metric_id", F.explode(F.array(normalize.normalize_value(F.col("original_value")))).alias("n"))
    return m.where("n.error IS NOT NULL").select("metric_id", "n.error")


def normalize_currency(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("metric_id", normalize.currency_code(F.col("currency")).alias("code"))


def normalize_unit(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("metric_id", normalize.unit_name(F.col("unit")).alias("unit_name"))


def numeric_cells(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of the cells of a ground-truth file's columns, as read from the raw records."""
    cells = csv_records.read_records(table(spark, d, "financial_metrics_raw").select("record_id", "raw_line")).where("reason IS NULL")
    return cells.select("record_id", number_cell(F.col("record.revenue").cast("string")).alias("revenue"))


def ground_truth_join(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.with_ground_truth(table(spark, d, "filings").select("filing_id", "company", "fiscal_year"), table(spark, d, "gt_records"))
    return out.select("filing_id", F.col("known.gt_id").alias("gt_id"), F.col("known.revenue").alias("revenue"))


def ground_truth_first_match(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.first_records(table(spark, d, "gt_records"), "gt_id").select("company_key", "fiscal_year", F.col("known.gt_id").alias("gt_id"))


def ground_truth_fields(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.known_fields(table(spark, d, "gt_records"))


def company_override(spark: SparkSession, d: str) -> DataFrame:
    filed = table(spark, d, "filings")
    given = filed.where("source_url IS NOT NULL").select("filename", "company", "fiscal_year")  # what is known beforehand
    return documents.with_overrides(filed.select("filing_id", "filename"), given).select("filing_id", "company", "fiscal_year")


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def pricing_match(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "llm_calls").where("model IS NOT NULL")
    return cost.matched_prices(models, _prices(spark)).select("model", "key")


def call_cost(spark: SparkSession, d: str) -> DataFrame:
    return cost.call_costs(_calls(spark, d), _prices(spark)).select("call_id", "priced", F.round("cost_usd", 9).alias("cost_usd"))


def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    out = cost.cost_rollup(cost.call_costs(_calls(spark, d), _prices(spark)), ["model"])
    return out.select("model", "calls", "input_tokens", "output_tokens", F.round("cost_known_usd", 6).alias("cost_known_usd"), F.round("cost_usd", 6).alias("cost_usd"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return context.latest_pages(table(spark, d, "parsed_pages"))


def all_text(spark: SparkSession, d: str) -> DataFrame:
    return context.all_text(_pages(spark, d)).select("document_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("bigint").alias("n"))


def keyword_pages(spark: SparkSession, d: str) -> DataFrame:
    return context.keyword_pages(_pages(spark, d))


def text_context(spark: SparkSession, d: str) -> DataFrame:
    return context.text_context(_pages(spark, d))


def layout_context(spark: SparkSession, d: str) -> DataFrame:
    return context.layout_context(_pages(spark, d), table(spark, d, "parsed_tables"))


def hybrid_context(spark: SparkSession, d: str) -> DataFrame:
    return context.hybrid_context(_pages(spark, d), table(spark, d, "parsed_tables"))


def table_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_tables").select("table_id", grids.table_text(F.col("rows")).alias("text"))


def table_headers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_tables").select("table_id", grids.looks_like_header(F.get(F.col("rows"), F.lit(0))).alias("first_is_header"))


def table_keyword(spark: SparkSession, d: str) -> DataFrame:
    return provenance.first_table_with(table(spark, d, "parsed_tables"), "net income").select("document_id", "page", "table_index", "table_id")


def table_grid(spark: SparkSession, d: str) -> DataFrame:
    """Tables taken apart into cells and put together again, filled up to full rows; an empty row counts, a table without any cell doesn't."""
    held = table(spark, d, "parsed_tables").where(F.exists("rows", lambda r: F.size(r) > 0)).select(F.monotonically_increasing_id().alias("_t"), "table_id", "rows")
    lines = held.select("_t", "table_id", F.posexplode("rows").alias("row", "_r"))
    flat = lines.select("_t", "table_id", "row", F.posexplode_outer("_r").alias("col", "text")).withColumn("col", F.coalesce("col", F.lit(0)))
    return pages.grid(flat, ["_t", "table_id"]).select("table_id", grids.table_text(F.col("rows")).alias("text"))


def block_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Blocks in order without the gaps of their index; of a block delivered again the one parsed last."""
    once = table(spark, d, "text_blocks").groupBy("document_id", "page", "block_index").agg(F.max("parsed_at").alias("parsed_at"))
    return pages.numbered(once).select("document_id", "page", "block_index", "running")


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_tables").groupBy("document_id").agg(F.count(F.lit(1)).alias("tables"), F.coalesce(F.max("table_index"), F.lit(0)).alias("last_index"))


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of blocks turned to the bottom of their page (a turn is its own reverse)."""
    heights = table(spark, d, "parsed_pages").groupBy("document_id", F.col("page_number").alias("page")).agg(F.max("height").alias("height"))
    out = table(spark, d, "text_blocks").join(heights, ["document_id", "page"], "left")
    return out.select("document_id", "page", "block_index", F.get(grids.top_left(F.col("bbox"), F.col("height")), F.lit(1)).alias("top"))


def mock_scan(spark: SparkSession, d: str) -> DataFrame:
    return extract.mock_scan(text_context(spark, d)).select("document_id", "field_name", "value", "source_text")


def json_clean(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("call_id", text.clean_json(F.col("text")).alias("cleaned"), text.json_object(F.col("text")).isNotNull().alias("is_object"))


def json_map(spark: SparkSession, d: str) -> DataFrame:
    return extract.json_metrics(_calls(spark, d).select("call_id", "text")).where("value IS NOT NULL").select("call_id", "field_name", "value", "original_value", "unit", "currency")


def assemble_status(spark: SparkSession, d: str) -> DataFrame:
    return extract.reports(extract.json_metrics(_calls(spark, d).select("call_id", "text")), ["call_id"]).select("call_id", "extracted", "status")


def keyword_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return provenance.keyword_occurrences(table(spark, d, "parsed_pages"), "net income").select("page_id", "position", "context")


def value_source(spark: SparkSession, d: str) -> DataFrame:
    values = _metrics(spark, d).select(F.col("metric_id").alias("value_id"), "document_id", F.col("original_value").alias("printed"))
    return provenance.value_sources(values, _pages(spark, d), table(spark, d, "text_blocks")).select(F.col("value_id").alias("metric_id"), "page", "source_text")


def content_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", documents.content_id(F.encode("text", "UTF-8")).alias("document_id"))


def ingest_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Documents to add where the parsed ones are stored already."""
    filed = table(spark, d, "filings").select("document_id", "filename", "page_count")
    return documents.new_documents(filed, filed.where("page_count IS NOT NULL")).select("document_id", "filename")


def filename_metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filings").select("filing_id", documents.name_company(F.col("filename")).alias("company"), documents.name_year(F.col("filename")).alias("fiscal_year"))


def recent_documents(spark: SparkSession, d: str) -> DataFrame:
    return newest(table(spark, d, "filings"), "ingested_at", "filing_id", 100).select("filing_id", "ingested_at")


def recent_experiments(spark: SparkSession, d: str) -> DataFrame:
    return newest(table(spark, d, "experiments"), "started_at", "experiment_id", 10).select("experiment_id", "started_at")


def metric_validation(spark: SparkSession, d: str) -> DataFrame:
    m = _metrics(spark, d)
    wrong = validate.metric_errors(F.col("value"), F.col("currency"), F.lit(None).cast("array<double>"), F.col("confidence"), F.col("page"), F.col("source_text"))
    return m.select("metric_id", F.array_join(wrong, ",").alias("errors"))


def consistency_checks(spark: SparkSession, d: str) -> DataFrame:
    return validate.consistency(_metrics(spark, d), ["extraction_id"]).select("extraction_id", F.array_join("warnings", ",").alias("warnings"))


def wide_report(spark: SparkSession, d: str) -> DataFrame:
    return wide_reports(_metrics(spark, d).withColumn("value", F.when(~F.isnan("value"), F.col("value"))), ["extraction_id"])


def _experiment(spark: SparkSession, d: str) -> Experiment:
    filed = table(spark, d, "filings").select("document_id", "company", "fiscal_year")
    parsed, blocks, tables, records = (table(spark, d, t) for t in ("parsed_pages", "text_blocks", "parsed_tables", "gt_records"))
    return Experiment(filed, parsed, blocks, tables, records, _prices(spark))


def experiment_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _experiment(spark, d).metrics.where("value IS NOT NULL").select("document_id", "pipeline", "field_name", "value", "original_value", "unit")


def experiment_reports(spark: SparkSession, d: str) -> DataFrame:
    return _experiment(spark, d).reports.select("document_id", "pipeline", "extracted", "status", F.size("errors").alias("n_errors"))


def experiment_provenance(spark: SparkSession, d: str) -> DataFrame:
    return _experiment(spark, d).provenance.select("document_id", "pipeline", "field_name", "page", "source_text")


def experiment_stored(spark: SparkSession, d: str) -> DataFrame:
    run = _experiment(spark, d)
    return run_rows(run.reports, run.metrics)[1].select("extraction_id", "field_name", "value")


def experiment_failures(spark: SparkSession, d: str) -> DataFrame:
    return _experiment(spark, d).failures.select("document_id", "pipeline", "field_name", "failure_type", "severity")


def experiment_summary(spark: SparkSession, d: str) -> DataFrame:
    return _experiment(spark, d).summary().select("pipeline", "documents", "coverage", "exact_accuracy_pct", "accuracy_1pct_pct", "accuracy_5pct_pct")


QUERIES = [
    p2_found, p2_loaded, p3_found, p3_quantities, field_result, failure_classify, failure_severity, failure_summary, failures_filtered, per_field_accuracy,
    per_company_accuracy, pipeline_metrics, coverage, accuracy_bars, failure_bars, latency_stats, latency_windows, normalize_value, normalize_errors,
    normalize_currency, normalize_unit, numeric_cells, ground_truth_join, ground_truth_first_match, ground_truth_fields, company_override, token_estimate,
    pricing_match, call_cost, cost_rollup, all_text, keyword_pages, text_context, layout_context, hybrid_context, table_to_text, table_headers, table_keyword,
    page_boxes, mock_scan, json_clean, json_map, assemble_status, keyword_occurrences, value_source, content_id, ingest_idempotent, filename_metadata,
    recent_documents, recent_experiments, metric_validation, consistency_checks, wide_report, experiment_metrics, experiment_reports, experiment_provenance,
    experiment_stored, experiment_failures, experiment_summary, table_grid, block_numbers, table_counts,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return sql.oracles(PRICES)
