import math

import pytest
from pyspark.sql import functions as F

from docmetrics.operators import evaluate as e, metrics as m, ranks

PAIR = "predicted double, ground_truth double, predicted_unit string, ground_truth_unit string, field_name string, pipeline string"


def pairs(spark, *rows):
    return e.with_errors(spark.createDataFrame([(p, g, "USD", "million USD", "revenue", "hybrid") for p, g in rows], PAIR))


def test_errors(spark):
    got = pairs(spark, (100.0, 100.0), (100.5, 100.0), (101.0, 100.0), (95.0, 100.0), (None, 1.0), (1.0, None), (3.0, 0.0), (0.0, 0.0), (float("nan"), 1.0), (-1.0, -2.0)).collect()
    assert [(r.absolute_error, r.relative_error) for r in got] == [(0, 0), (0.5, 0.005), (1, 0.01), (5, 0.05), (None, None), (None, None), (3, None), (0, None), (None, None), (1, 0.5)]
    assert [r.exact_match for r in got][:2] == [True, False] and got[7].exact_match is True and got[6].within_5pct is None
    assert [r.within_05pct for r in got][:3] == [True, True, False] and [r.within_1pct for r in got][:4] == [True, True, True, False] and got[3].within_5pct


@pytest.mark.parametrize(("p", "g", "kind", "how_bad"), [
    (None, 5.0, "MISSING_VALUE", "medium"), (-100.0, 100.0, "SIGN_ERROR", "high"), (-104.0, 100.0, "SIGN_ERROR", "high"), (1e8, 100.0, "UNIT_NORMALIZATION", "critical"),
    (1e5, 100.0, "UNIT_NORMALIZATION", "critical"), (0.1, 100.0, "UNIT_NORMALIZATION", "critical"), (-1e5, 100.0, "UNIT_NORMALIZATION", "critical"), (106.0, 100.0, "NEEDS_REVIEW", "high"), (150.0, 100.0, "NEEDS_REVIEW", "critical"),
])
def test_failures(spark, p, g, kind, how_bad):
    row = e.failures(pairs(spark, (p, g))).first()
    assert (row.failure_type, row.severity) == (kind, how_bad)


def test_what_doesnt_fail(spark):
    assert e.failures(pairs(spark, (5.0, 0.0), (100.0, None), (None, None), (104.9, 100.0))).count() == 0


def test_causes_and_severities(spark):
    row = e.failures(pairs(spark, (1e5, 100.0))).first()
    assert row.root_cause == "scaled by 1,000 (USD for million USD)"
    df = spark.createDataFrame([("NEEDS_REVIEW", v) for v in (None, 0.005, 0.02, 0.1, 0.3)] + [("VALIDATION_ERROR", 0.001)], "k string, r double")
    assert [r.s for r in df.select(e.severity(F.col("k"), F.col("r")).alias("s")).collect()] == ["medium", "low", "medium", "high", "critical", "high"]
    invalid = spark.range(1).select(e.failure_type(F.lit(5.0), F.lit(5.0), F.lit(True)).alias("k"), e.failure_type(F.lit(5.0), F.lit(None).cast("double")).alias("r")).first()
    assert (invalid.k, invalid.r) == ("VALIDATION_ERROR", "NEEDS_REVIEW")
    assert spark.range(1).select(e.near(F.lit(0.04), 0.0).alias("x")).first().x


def test_counts_of_failures(spark):
    df = spark.createDataFrame([("B",), ("A",), ("B",), (None,)], "failure_type string")
    assert [tuple(r) for r in e.failure_counts(df).collect()] == [("B", 2), ("A", 1), ("OTHER", 1)]
    assert {tuple(r) for r in m.failure_bars(df).collect()} == {("B", 2), ("A", 1), ("Unknown Error", 1)}


GT = "gt_id bigint, company string, fiscal_year int, revenue double, net_income double, operating_income double, total_assets double, total_liabilities double, cash_and_equivalents double, eps double, currency string, unit string, source string"


def record(i, company, year, revenue=1.0):
    return (i, company, year, revenue, None, None, None, None, None, 2.0, "USD", "million USD", None)


def test_first_record_of_a_company_counts(spark):
    gt = spark.createDataFrame([record(2, "Acme Inc.", 2022, 20.0), record(1, " ACME INC", 2022, 10.0), record(3, None, 2022), record(4, "Acme Inc", None)], GT)
    runs = spark.createDataFrame([("r1", "d", "hybrid", "acme inc.", 2022), ("r2", "d", "hybrid", "Other", 2022), ("r3", "d", "hybrid", None, 2022)], "run_id string, document_id string, pipeline string, company string, fiscal_year int")
    known = {r.run_id: r.known and r.known.gt_id for r in e.with_ground_truth(runs, gt).collect()}
    assert known == {"r1": 1, "r2": None, "r3": None}
    got = spark.createDataFrame([("r1", "revenue", 10.0, "USD"), ("r1", "revenue", 9.0, "USD"), ("r1", "other", 5.0, "USD"), ("r2", "revenue", 1.0, "USD")], "run_id string, field_name string, value double, unit string")
    out = {r.field_name: r for r in e.field_results(runs, got, gt).collect()}
    assert len(out) == 7 and out["revenue"].exact_match and out["eps"].predicted is None and out["eps"].ground_truth == 2.0
    assert e.known_fields(gt).count() == 7
    assert e.field_results(runs.where("false"), got, gt).count() == 0


def test_accuracies(spark):
    df = pairs(spark, (100.0, 100.0), (100.8, 100.0), (104.0, 100.0), (200.0, 100.0), (None, 100.0), (1.0, None), (0.0, 0.0))
    r = m.accuracy(df, ["pipeline"]).first()
    assert (r.total_fields, r.extracted_fields, r.missing_fields) == (7, 6, 1)
    assert (r.exact_accuracy, r.accuracy_05pct, r.accuracy_1pct, r.accuracy_5pct) == (2 / 5, 1 / 5, 2 / 5, 3 / 5)
    assert r.mean_absolute_error == pytest.approx(104.8 / 5) and r.mean_relative_error == pytest.approx(1.048 / 4) and r.per_field_accuracy == {"revenue": 2 / 5}
    none = m.accuracy(pairs(spark, (None, 1.0)), ["pipeline"]).first()
    assert (none.exact_accuracy, none.mean_absolute_error, none.per_field_accuracy) == (0.0, None, {})
    assert m.field_accuracy(pairs(spark, (None, 1.0)), ["pipeline"]).count() == 0


def test_pipeline_metrics(spark):
    runs = spark.createDataFrame([("hybrid", 10.0, 0.5, "valid"), ("hybrid", 30.0, None, "invalid"), ("text_only", None, 0.0, None)], "pipeline string, latency_ms double, cost_usd double, status string")
    got = {r.pipeline: r for r in m.pipeline_metrics(pairs(spark, (1.0, 1.0), (None, 1.0)), runs).collect()}
    h, t = got["hybrid"], got["text_only"]
    assert (h.document_count, h.mean_latency_ms, h.median_latency_ms, h.total_cost_usd, h.cost_per_document_usd, h.cost_per_100_fields_usd, h.cost_per_successful_extraction_usd, h.validation_failure_rate) == (2, 20.0, 20.0, 0.5, 0.25, 25.0, 0.5, 0.5)
    assert (t.total_cost_usd, t.mean_latency_ms, t.total_fields, t.exact_accuracy, t.validation_failure_rate) == (None, None, 0, 0.0, 0.0)
    s = {r.pipeline: r for r in m.summary(m.pipeline_metrics(pairs(spark, (1.0, 1.0), (None, 1.0)), runs)).collect()}
    assert s["hybrid"].coverage == 50.0 and s["text_only"].mean_latency_ms == 0.0
    assert m.accuracy_bars(m.pipeline_metrics(pairs(spark, (1.0, 1.0)), runs)).count() == 6 and m.latency_points(m.pipeline_metrics(pairs(spark, (1.0, 1.0)), runs)).count() == 2


def exact(values):
    v = sorted(values)
    n = len(v)
    return (sum(v) / n, (v[(n - 1) // 2] + v[n // 2]) / 2, v[min(int(0.95 * n + 0.5), n - 1)], v[0], v[-1])


def test_latencies_against_sorting(spark):
    import random

    rng = random.Random(3)
    groups = {"a": [float(i) for i in range(1, 21)], "b": [rng.lognormvariate(5, 3) for _ in range(999)], "c": [5.0] * 40, "d": [-3.0, 0.0, 1e-9, 2.0], None: [7.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", None), ("a", float("nan")), ("e", None)]
    got = {r.g: r for r in ranks.latency_stats(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        r = got[k]
        assert r.n == len(vs) and all(math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-15) for x, y in zip((r["mean"], r["median"], r.p95, r.least, r.most), exact(vs)))
    assert got["a"].p95 == 20.0
    assert ranks.latency_stats(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_coverage_and_stage_times(spark):
    df = spark.createDataFrame([("x", "revenue", 1.0), ("x", "revenue", 2.0), ("x", "odd", 1.0), ("y", "eps", None)], "k string, field_name string, value double")
    assert {r.k: (r.extracted, r.status) for r in m.coverage(df, ["k"]).collect()} == {"x": (1, "partial"), "y": (0, "invalid")}
    assert spark.createDataFrame([(1.0, None), (None, None)], "a double, b double").select(m.stage_total("a", "b").alias("x")).collect() == [(1.0,), (0.0,)]
