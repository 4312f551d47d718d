"""Ground-truth CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docmetrics.functions.normalize import NUMBER
from docmetrics.functions.text import strip
from docmetrics.schemas import GROUND_TRUTH, METRICS


def number_cell(cell: Column) -> Column:
    """A cell's number: blank is null, commas don't count; null too if it isn't a number."""
    x = F.replace(strip(cell), F.lit(","), F.lit(""))
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def read_ground_truth(spark: SparkSession, path: str, extra: DataFrame | None = None) -> DataFrame:
    """The rows of the CSV files with ``ordinal``, their order, then those of ``extra``.

    Rows with a year or number that can't be read are left out (:func:`skipped_rows` has them); a missing column is an error.
    """
    out = _cast(_raw(spark, path)).where("NOT _bad").drop("_bad", "_line")
    if extra is not None:
        first = F.lit(1 << 62) + F.monotonically_increasing_id()
        out = out.unionByName(extra.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in GROUND_TRUTH], first.alias("ordinal")))
    return out


def skipped_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that :func:`read_ground_truth` leaves out, as text."""
    return _cast(_raw(spark, path)).where("_bad").select("_line")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=True)
    if missing := set(GROUND_TRUTH.names) - set(raw.columns):
        raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
    return raw.select(*GROUND_TRUTH.names, F.monotonically_increasing_id().alias("ordinal"))


def _cast(raw: DataFrame) -> DataFrame:
    year = strip(F.col("fiscal_year"))
    bad = ~F.coalesce(year.rlike(r"^[+-]?[0-9]{1,9}$"), F.lit(False))
    for m in METRICS:
        bad = bad | ((strip(F.coalesce(F.col(m), F.lit(""))) != "") & number_cell(F.col(m)).isNull())
    text = [F.col(c) for c in ("currency", "unit", "source")]
    return raw.select(strip(F.col("company")).alias("company"), year.try_cast("int").alias("fiscal_year"), *[number_cell(F.col(m)).alias(m) for m in METRICS], *text, "ordinal", bad.alias("_bad"), F.to_csv(F.struct(*GROUND_TRUTH.names)).alias("_line"))
