"""Extracted fields against known right values: errors, failures, severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docmetrics.schemas import METRICS

# Classes of failures, and the factors of a wrong scale in the order they are tried.
MISSING, REVIEW, INVALID, SIGN, UNIT, OTHER = "MISSING_VALUE", "NEEDS_REVIEW", "VALIDATION_ERROR", "SIGN_ERROR", "UNIT_NORMALIZATION", "OTHER"
FACTORS = [(1e6, "1,000,000"), (1e3, "1,000"), (1e9, "1,000,000,000"), (1 / 1e6, "1/1,000,000"), (1 / 1e3, "1/1,000"), (1 / 1e9, "1/1,000,000,000")]
#: Relative error above which a field counts as failed; how near a ratio must be to a factor.
TOLERANCE, NEAR = 0.05, 0.05


def _number(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def with_errors(df: DataFrame, predicted: str = "predicted", known: str = "ground_truth") -> DataFrame:
    """Add absolute_error, relative_error, exact_match, within_05pct, within_1pct, within_5pct and note.

    Without either value all are null.  Against a known value of zero only the absolute error and exact match are defined.  NaN counts
    as missing.  Columns of those names are replaced.
    """
    p, g = _number(F.col(predicted)), _number(F.col(known))
    apart = F.abs(p - g)
    relative = F.try_divide(apart, F.abs(g))
    note = F.when(p.isNull() | g.isNull(), "a value is missing").when(g == 0, "the known value is zero: no relative error")
    within = {"within_05pct": 0.005, "within_1pct": 0.01, "within_5pct": 0.05}
    return df.withColumns({"absolute_error": apart, "relative_error": relative, "exact_match": p == g, **{k: relative <= v for k, v in within.items()}, "note": note})


def near(value: Column, target: float, tolerance: float = NEAR) -> Column:
    """Whether ``value`` is within ``tolerance`` of ``target``, relative to it (absolute if it is zero)."""
    return F.abs(value) < tolerance if target == 0 else F.abs(value / target - 1.0) <= tolerance


def failure_type(predicted: Column, known: Column, invalid: Column | None = None) -> Column:
    """Class of a failed field, the first that applies: no prediction, no known value, invalid, opposite sign, wrong scale; else for review.

    A wrong scale with a wrong sign counts as a wrong scale.
    """
    p, g = _number(predicted), _number(known)
    ratio = F.try_divide(p, g)
    scaled = F.exists(F.array(*[F.lit(f) for f, _ in FACTORS]), lambda f: F.abs(F.abs(ratio) / f - 1.0) <= NEAR)
    out = F.when(p.isNull(), MISSING).when(g.isNull(), REVIEW)
    if invalid is not None:
        out = out.when(invalid, INVALID)
    return out.when(near(ratio, -1.0), SIGN).when((p != 0) & scaled, UNIT).otherwise(REVIEW)


def root_cause(kind: Column, predicted: Column, known: Column, predicted_unit: Column, known_unit: Column) -> Column:
    """What probably went wrong, in words; null where only a review can tell."""
    ratio = F.abs(F.try_divide(predicted, known))
    factor = F.coalesce(*[F.when(near(ratio, f), F.lit(name)) for f, name in FACTORS])
    units = F.when((predicted_unit != "") & (known_unit != ""), F.concat(F.lit(" ("), predicted_unit, F.lit(" for "), known_unit, F.lit(")"))).otherwise("")
    scale = F.concat(F.lit("scaled by "), factor, F.coalesce(units, F.lit("")))
    return F.when(kind == MISSING, "nothing was extracted").when(kind == INVALID, "the value failed validation").when(kind == SIGN, "the sign is reversed").when(kind == UNIT, scale)


def severity(kind: Column, relative_error: Column) -> Column:
    """low, medium, high or critical, by class or else by relative error (1 %, 5 %, 20 %)."""
    by_size = F.when(relative_error.isNull(), "medium").when(relative_error < 0.01, "low").when(relative_error < 0.05, "medium").when(relative_error < 0.20, "high")
    return F.when(kind == MISSING, "medium").when(kind.isin(INVALID, SIGN), "high").when(kind == UNIT, "critical").otherwise(by_size.otherwise("critical"))


def failures(results: DataFrame) -> DataFrame:
    """The failed rows of field results, with failure_type, root_cause and severity.

    Failed are fields with a known value and no prediction, or a relative error above 5 %; against zero nothing fails.
    """
    p, g = _number(F.col("predicted")), _number(F.col("ground_truth"))
    failed = results.where(g.isNotNull() & (p.isNull() | (F.col("relative_error") > TOLERANCE)))
    kind = failure_type(p, g)
    failed = failed.withColumn("failure_type", kind)
    cause = root_cause(F.col("failure_type"), p, g, F.col("predicted_unit"), F.col("ground_truth_unit"))
    return failed.withColumns({"root_cause": cause, "severity": severity(F.col("failure_type"), F.col("relative_error"))})


def failure_counts(failed: DataFrame, kind: str = "failure_type") -> DataFrame:
    """(failure_type, failures): most frequent first, then by name; no class counts as OTHER."""
    out = failed.groupBy(F.coalesce(F.col(kind), F.lit(OTHER)).alias("failure_type")).agg(F.count(F.lit(1)).alias("failures"))
    return out.orderBy(F.desc("failures"), "failure_type")


def company_key(company: Column) -> Column:
    """What companies are matched by: lower case, without spaces and full stops at either end."""
    return F.btrim(F.lower(company), F.lit(" ."))


def first_records(records: DataFrame, order: str) -> DataFrame:
    """One ground-truth row per company key and fiscal year: the first by ``order``.  Null companies or years match nothing and are left out."""
    keyed = records.withColumn("company_key", company_key(F.col("company"))).where("company_key IS NOT NULL AND fiscal_year IS NOT NULL")
    row = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    return keyed.groupBy("company_key", "fiscal_year").agg(F.min_by(row, order).alias("known"))


def with_ground_truth(reports: DataFrame, records: DataFrame, order: str = "gt_id") -> DataFrame:
    """Each report with ``known``, its ground-truth row as a struct, null where there is none."""
    keyed = reports.withColumn("company_key", company_key(F.col("company")))
    return keyed.join(first_records(records, order), ["company_key", "fiscal_year"], "left").drop("company_key")


def known_fields(records: DataFrame, order: str = "gt_id") -> DataFrame:
    """(company_key, fiscal_year, field_name, ground_truth, ground_truth_unit): the known values in long form, nulls too."""
    first = first_records(records, order)
    pairs = F.array(*[F.struct(F.lit(m).alias("field_name"), F.col(f"known.{m}").alias("ground_truth")) for m in METRICS])
    return first.select("company_key", "fiscal_year", F.col("known.unit").alias("ground_truth_unit"), F.inline(pairs)).select("company_key", "fiscal_year", "field_name", "ground_truth", "ground_truth_unit")


def field_results(runs: DataFrame, metrics: DataFrame, records: DataFrame, order: str = "gt_id") -> DataFrame:
    """Seven rows for each run that has a ground-truth row: (run columns, field_name, predicted, predicted_unit, ground_truth, ground_truth_unit, errors).

    ``runs`` has run_id, document_id, pipeline, company and fiscal_year; ``metrics`` has run_id, field_name, value and unit, at most
    one row for each field (of several the one with the highest value and unit counts).  Values are compared as they are; units aren't
    reconciled, so that a wrong scale shows as a failure.
    """
    known = with_ground_truth(runs, records, order).where("known IS NOT NULL")
    pairs = F.array(*[F.struct(F.lit(m).alias("field_name"), F.col(f"known.{m}").alias("ground_truth")) for m in METRICS])
    wanted = known.select(*[F.col(f"`{c}`") for c in runs.columns], F.col("known.unit").alias("ground_truth_unit"), F.inline(pairs))
    one = metrics.where("run_id IS NOT NULL AND field_name IS NOT NULL").groupBy("run_id", "field_name").agg(F.max(F.struct("value", "unit")).alias("m"))
    one = one.select("run_id", "field_name", _number(F.col("m.value")).alias("predicted"), F.col("m.unit").alias("predicted_unit"))
    return with_errors(wanted.join(one, ["run_id", "field_name"], "left"))
