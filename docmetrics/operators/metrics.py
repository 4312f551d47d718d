"""Aggregates of field results and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docmetrics.operators.ranks import latency_stats
from docmetrics.schemas import METRICS


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _counts() -> list[Column]:
    both = F.col("predicted").isNotNull() & F.col("ground_truth").isNotNull()
    flags = {"exact": "exact_match", "within_05": "within_05pct", "within_1": "within_1pct", "within_5": "within_5pct"}
    return [
        F.count(F.lit(1)).alias("fields"), F.count("predicted").alias("extracted"), F.count_if(both).alias("comparable"),
        *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(k) for k, c in flags.items()],
        F.sum("absolute_error").alias("abs_sum"), F.count("absolute_error").alias("abs_n"), F.sum("relative_error").alias("rel_sum"), F.count("relative_error").alias("rel_n"),
    ]


def field_accuracy(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field_name, comparable, accuracy_1pct): share of comparable rows within 1 %; fields without any are left out."""
    out = results.groupBy(*keys, "field_name").agg(*_counts()).where("comparable > 0")
    return out.select(*keys, "field_name", "comparable", share(F.col("within_1"), F.col("comparable")).alias("accuracy_1pct"))


def accuracy(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: counts, coverage, accuracies, mean errors and the map of accuracies by field.

    Accuracies are over comparable rows (both values known), 0 without any; a flag that is null, as against a known zero, is a miss.
    Means are null without any error.  Rows are counted once by field, then summed: one pass over the results.
    """
    by_field = results.groupBy(*keys, "field_name").agg(*_counts())
    entry = F.when(F.col("comparable") > 0, F.struct("field_name", share(F.col("within_1"), F.col("comparable")).alias("accuracy")))
    sums = [F.sum(c).alias(c) for c in ("fields", "extracted", "comparable", "exact", "within_05", "within_1", "within_5", "abs_sum", "abs_n", "rel_sum", "rel_n")]
    out = by_field.groupBy(*keys).agg(*sums, F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("per_field_accuracy"))  # a row for each field
    n, c = F.col("fields"), F.col("comparable")
    return out.select(
        *keys, F.col("fields").alias("total_fields"), F.col("extracted").alias("extracted_fields"), (n - F.col("extracted")).alias("missing_fields"),
        share(F.col("extracted"), n).alias("extraction_coverage"), share(n - F.col("extracted"), n).alias("missing_value_rate"),
        *[share(F.col(a), c).alias(b) for a, b in (("exact", "exact_accuracy"), ("within_05", "accuracy_05pct"), ("within_1", "accuracy_1pct"), ("within_5", "accuracy_5pct"))],
        F.try_divide("abs_sum", "abs_n").alias("mean_absolute_error"), F.try_divide("rel_sum", "rel_n").alias("mean_relative_error"), "per_field_accuracy",
    )


def pipeline_metrics(results: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per pipeline with all figures: accuracy, latency, cost and failed validations.

    ``runs`` has pipeline, latency_ms, cost_usd and status, one row for each run.  The total cost is the sum of what is known, null if that is nothing or zero;
    the three derived costs are null with it.  A run whose status is ``invalid`` failed validation.  Pipelines with runs only have zero fields.
    """
    status = F.count_if(F.coalesce(F.col("status") == "invalid", F.lit(False)))
    totals = runs.groupBy("pipeline").agg(F.count(F.lit(1)).alias("document_count"), F.sum("cost_usd").alias("_cost"), status.alias("_invalid"))
    times = latency_stats(runs, ["pipeline"])
    times = times.select("pipeline", F.col("mean").alias("mean_latency_ms"), F.col("median").alias("median_latency_ms"), F.col("p95").alias("p95_latency_ms"), F.col("least").alias("min_latency_ms"), F.col("most").alias("max_latency_ms"))
    out = totals.join(times, "pipeline", "left").join(accuracy(results, ["pipeline"]), "pipeline", "left")
    zero = ["total_fields", "extracted_fields", "missing_fields", "extraction_coverage", "missing_value_rate", "exact_accuracy", "accuracy_05pct", "accuracy_1pct", "accuracy_5pct"]
    out = out.fillna(0, zero)
    cost = F.when(F.col("_cost") > 0, F.col("_cost"))
    out = out.withColumns({
        "total_cost_usd": cost,
        "cost_per_document_usd": F.try_divide(cost, F.col("document_count")),
        "cost_per_100_fields_usd": F.try_divide(cost, F.col("total_fields")) * 100,
        "cost_per_successful_extraction_usd": F.try_divide(cost, F.col("extracted_fields")),
        "validation_failure_rate": share(F.col("_invalid"), F.col("document_count")),
    })
    return out.drop("_cost", "_invalid")


def summary(metrics: DataFrame) -> DataFrame:
    """The figures of a report: percentages and milliseconds to one decimal, missing latencies as 0."""
    percent = {"coverage": "extraction_coverage", "exact_accuracy_pct": "exact_accuracy", "accuracy_1pct_pct": "accuracy_1pct", "accuracy_5pct_pct": "accuracy_5pct"}
    times = [F.bround(F.coalesce(c, F.lit(0.0)), 1).alias(c) for c in ("mean_latency_ms", "p95_latency_ms")]
    return metrics.select("pipeline", F.col("document_count").alias("documents"), *[F.bround(F.col(c) * 100, 1).alias(k) for k, c in percent.items()], *times, "total_cost_usd", F.col("cost_per_document_usd").alias("cost_per_doc_usd"))


def coverage(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, extracted, coverage, status): how many of the seven fields a run has; none is ``invalid``, some ``partial``, all ``valid``."""
    named = F.when(F.col("field_name").isin(METRICS) & F.col("value").isNotNull(), F.col("field_name"))
    out = metrics.groupBy(*keys).agg(F.count_distinct(named).alias("extracted"))
    return out.select(*keys, "extracted", (F.col("extracted") / len(METRICS)).alias("coverage"), status(F.col("extracted")).alias("status"))


def status(extracted: Column) -> Column:
    return F.when(extracted == 0, "invalid").when(extracted < len(METRICS), "partial").otherwise("valid")


def stage_total(*times: str) -> Column:
    """The sum of stage times, missing ones as 0."""
    return sum((F.coalesce(F.col(t), F.lit(0.0)) for t in times), F.lit(0.0))


def accuracy_bars(metrics: DataFrame) -> DataFrame:
    """(pipeline, measure, accuracy): what a bar chart of the accuracies draws."""
    return metrics.select("pipeline", "exact_accuracy", "accuracy_1pct", "accuracy_5pct").unpivot("pipeline", ["exact_accuracy", "accuracy_1pct", "accuracy_5pct"], "measure", "accuracy")


def failure_bars(failed: DataFrame) -> DataFrame:
    """(failure_type, failures): failure_type, else error_type where there is such a column, else ``Unknown Error``; most frequent first."""
    named = [F.col(c) for c in ("failure_type", "error_type") if c in failed.columns]
    return failed.groupBy(F.coalesce(*named, F.lit("Unknown Error")).alias("failure_type")).agg(F.count(F.lit(1)).alias("failures")).orderBy(F.desc("failures"), "failure_type")


def latency_points(metrics: DataFrame) -> DataFrame:
    """(pipeline, seconds, accuracy_1pct): what a chart of latency against accuracy draws; missing latencies are 0."""
    return metrics.select("pipeline", (F.coalesce("mean_latency_ms", F.lit(0.0)) / 1000).alias("seconds"), "accuracy_1pct")
