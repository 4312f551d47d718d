"""The stored tables: Parquet folders with fixed schemas, appended to and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmetrics.schemas import KEYS, METRICS, TABLES


class Store:
    """A folder with one Parquet table for each of :data:`docmetrics.schemas.TABLES`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def create(self) -> None:
        """Make every table that doesn't exist yet."""
        for name, schema in TABLES.items():
            if not self._exists(name):
                self.spark.createDataFrame([], schema).write.mode("ignore").parquet(self.path(name))

    def drop(self) -> None:
        """Delete all tables with their rows."""
        for name in [*TABLES, "status_events"]:
            where = self._hadoop(name)
            where[0].delete(where[1], True)

    def _hadoop(self, name: str) -> tuple:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._hadoop(name)
        return fs.exists(path)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(self.path(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """Add the rows whose key isn't stored yet; repeated keys among them count once (the least row).  One atomic write.

        Columns the table has and ``rows`` lacks are null, others are left out.  Rows with a null in their key are an error.
        """
        keys = KEYS[name]
        have = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name]]
        typed = rows.select(*have)
        for k in keys:
            typed = typed.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null {k} in {name}"))).otherwise(F.col(k)))
        rest = [c for c in typed.columns if c not in keys]
        once = typed.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*")
        old = self.read(name).select(*keys)
        once.join(old, keys, "left_anti").select(*TABLES[name].names).write.mode("append").parquet(self.path(name))

    def set_status(self, changes: DataFrame) -> None:
        """Append (document_id, status) changes; unknown documents are an error.  :meth:`documents` shows the latest."""
        unknown = changes.join(self.read("documents").select("document_id"), "document_id", "left_anti").select("document_id").limit(1).collect()
        if unknown:
            raise ValueError(f"no such document: {unknown[0][0]}")
        stamped = changes.select("document_id", "status", F.current_timestamp().cast("timestamp_ntz").alias("changed_at"))
        stamped.write.mode("append").parquet(self.path("status_events"))

    def documents(self) -> DataFrame:
        """The documents with their latest status."""
        out = self.read("documents")
        if not self._exists("status_events"):
            return out
        last = self.spark.read.parquet(self.path("status_events")).groupBy("document_id").agg(F.max_by("status", F.struct("changed_at", "status")).alias("_s"))
        return out.join(last, "document_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def newest(df: DataFrame, by: str, key: str, limit: int = 100) -> DataFrame:
    """The newest rows, ties by key; rows without a time come last."""
    return df.orderBy(F.desc_nulls_last(by), key).limit(limit)


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """The rows that have all the wanted values; an empty or missing value doesn't filter."""
    for column, value in wanted.items():
        if value:
            df = df.where(F.col(column) == value)
    return df


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with that key, or none."""
    return df.where(F.col(key) == value).limit(1)


def run_rows(reports: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(extractions, metrics) to store for reports (document_id, pipeline, status, ...) and their metrics in long form.

    The id of an extraction is a digest of document, pipeline and experiment (where there is one), so that a repeated write adds nothing.
    """
    parts = ["document_id", "pipeline", *(["experiment_id"] if "experiment_id" in reports.columns else [])]
    run_id = F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32).alias("extraction_id")
    body = metrics.where("value IS NOT NULL").groupBy("document_id", "pipeline").agg(F.array_sort(F.collect_list(F.struct("field_name", "value", "unit", "currency"))).alias("metrics"))  # seven at most
    extractions = reports.join(body, ["document_id", "pipeline"], "left").select(run_id, "document_id", "pipeline", F.col("status").alias("validation_status"), F.to_json(F.struct("status", "errors", "metrics")).alias("result_json"), F.current_timestamp().cast("timestamp_ntz").alias("created_at"))
    rows = metrics.where("value IS NOT NULL").join(reports.select(*dict.fromkeys(parts)), ["document_id", "pipeline"]).select(run_id, "field_name", "value", "original_value", "unit", "currency", "source_text", "confidence")
    return extractions, rows


def wide_reports(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, one column for each of the seven fields), of repeated fields the highest value."""
    return metrics.groupBy(*keys).pivot("field_name", METRICS).agg(F.max("value"))


def bounding_box(bbox_json: str) -> "F.Column":
    """A stored box as an array, null if it isn't one."""
    return F.from_json(F.col(bbox_json), "array<double>")


def write_summary(summary: DataFrame, path: str) -> None:
    """The summary of an experiment as JSON lines."""
    summary.write.mode("overwrite").json(path)
