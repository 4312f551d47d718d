"""Calibrated forests that predict what a record doesn't state, from magnitude, category, source and neighbouring fields.

Two targets: the currency, and the scale of a printed number.  Both are trained on records that state them, with the statement hidden.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from docmetrics.schemas import METRICS, PIPELINES

#: A prediction is used from this calibrated probability on.
CONFIDENT = 0.9
#: At most about so many labelled rows train a forest and its calibration.
SAMPLE = 50_000
CURRENCIES = ["USD", "EUR", "GBP", "INR", "JPY", "CHF", "CAD", "AUD"]
SCALES = [1.0, 0.01, 1e3, 1e5, 1e6, 1e7, 1e8, 1e9, 1e12]


def _index(values: list, c: str) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(c)).cast("double"), F.lit(0.0))


def features(base: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Add the feature columns to ``rows`` of ``base``, by default all of them: records with metric_id, document_id, field_name, pipeline, number, value, currency, scale and scale_known.

    All records of the rows' documents are counted, whichever rows are asked for.

    The neighbours are the other records of the document: the share of each currency and each scale among those that state one, and how far the printed number
    is from the amounts that others state for the same field and for any field.  A record's own statement never counts among its neighbours.
    """
    size = F.log10(F.abs("number") + 1)
    told = F.col("scale_known")
    amount = F.when(told, F.log10(F.abs(F.col("number") * F.col("scale")) + 1))
    rows = base if rows is None else rows
    x = base.select("document_id", "field_name", "currency", "scale", "scale_known", amount.alias("_amount")).join(rows.select("document_id").distinct(), "document_id", "left_semi")
    sums = [F.sum("_amount").alias("_sum"), F.count("_amount").alias("_n")]
    counts = [F.count_if(F.col("currency") == c).alias(f"_c{i}") for i, c in enumerate(CURRENCIES)] + [F.count_if(told & (F.col("scale") == s)).alias(f"_s{i}") for i, s in enumerate(SCALES)]
    per_doc = x.groupBy("document_id").agg(*counts, F.count("currency").alias("_money"), F.count_if(told).alias("_told"), *[c.alias(f"_doc{i}") for i, c in enumerate(sums)])
    per_field = x.groupBy("document_id", "field_name").agg(*[c.alias(f"_field{i}") for i, c in enumerate(sums)])
    x = rows.withColumns({"size": size, "_amount": amount}).join(per_doc, "document_id", "left").join(per_field, ["document_id", "field_name"], "left")
    own_amount, own_told = F.coalesce("_amount", F.lit(0.0)), told.cast("int")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    others = {f"near_{i}": zero(F.try_divide(F.col(f"_c{i}") - F.coalesce((F.col("currency") == c).cast("int"), F.lit(0)), F.col("_money") - F.col("currency").isNotNull().cast("int"))) for i, c in enumerate(CURRENCIES)}
    others |= {f"scaled_{i}": zero(F.try_divide(F.col(f"_s{i}") - (told & (F.col("scale") == s)).cast("int"), F.col("_told") - own_told)) for i, s in enumerate(SCALES)}
    gaps = {k: zero(F.try_divide(F.col(f"_{k}0") - own_amount, F.col(f"_{k}1") - own_told) - size) for k in ("doc", "field")}
    ratio = zero(F.log10(F.try_divide(F.abs("value"), F.abs("number")) + 1e-9))
    return x.withColumns({**others, **{f"gap_{k}": v for k, v in gaps.items()}, "ratio": ratio, "field": _index(METRICS, "field_name"), "source": _index(PIPELINES, "pipeline")})


COLUMNS = [*(f"near_{i}" for i in range(len(CURRENCIES))), *(f"scaled_{i}" for i in range(len(SCALES))), "gap_doc", "gap_field", "ratio", "size", "field", "source"]


class Model:
    """A forest and the isotonic curve that maps its highest vote to the chance that it is right."""

    def __init__(self, forest: PipelineModel, curve: list[tuple[float, float]], classes: list) -> None:
        self.forest, self.curve, self.classes = forest, curve, classes

    def predict(self, x: DataFrame) -> DataFrame:
        """Add ``predicted`` and ``chance`` to rows with features."""
        out = self.forest.transform(x).withColumn("_top", F.array_max(vector_to_array("probability")))
        chance = F.lit(self.curve[0][1])
        for (a, p), (b, q) in zip(self.curve, self.curve[1:]):
            at = p + (q - p) * (F.col("_top") - a) / max(b - a, 1e-9)
            chance = F.when(F.col("_top") >= a, F.least(at, F.lit(max(p, q)))).otherwise(chance)
        value = F.get(F.array(*map(F.lit, self.classes)), F.col("prediction").cast("int"))
        return out.withColumn("predicted", value).withColumn("chance", chance).drop("rawPrediction", "probability", "prediction", "features", "_top")


def picks(base: DataFrame, targets: dict[str, tuple[list, Column]], sample: int = SAMPLE) -> dict[str, Column]:
    """For each target a condition that picks about ``sample`` rows at most of those whose target is known and one of its classes.

    Rows are picked by a digest of their id, so that the choice doesn't depend on partitions.
    """
    told = {t: F.coalesce(known & F.col(t).isin(classes), F.lit(False)) for t, (classes, known) in targets.items()}
    counts = base.agg(*[F.count_if(c).alias(t) for t, c in told.items()]).first()
    u = F.pmod(F.xxhash64("metric_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    return {t: c & (u < sample / counts[t]) if counts[t] > sample else c for t, c in told.items()}


def train(x: DataFrame, target: str, classes: list) -> Model | None:
    """Fit on rows with features whose target is one of ``classes``: four fifths of the documents for the forest, the others for the curve.  None without two classes to tell apart."""
    rows = x.withColumn("label", _index(classes, target) - 1).withColumn("fold", F.pmod(F.xxhash64("document_id"), F.lit(5))).select(*COLUMNS, "label", "fold").persist()
    forest = Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features"), RandomForestClassifier(numTrees=40, maxDepth=10, seed=3)])
    try:
        if rows.where("fold > 0").select("label").distinct().limit(2).count() < 2:
            return None
        fitted = forest.fit(rows.where("fold > 0"))
        held = fitted.transform(rows.where("fold = 0")).select(F.array_max(vector_to_array("probability")).alias("top"), (F.col("prediction") == F.col("label")).cast("double").alias("label"))
        if held.isEmpty():
            return Model(fitted, [(0.0, 0.0), (1.0, 1.0)], classes)
        iso = IsotonicRegression(featuresCol="top", labelCol="label").fit(held)
        return Model(fitted, list(zip(map(float, iso.boundaries), map(float, iso.predictions))) or [(0.0, 0.0)], classes)
    finally:
        rows.unpersist()
