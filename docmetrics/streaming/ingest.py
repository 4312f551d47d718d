"""Documents and calls as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from docmetrics.sources.documents import ingest
from docmetrics.storage import Store


def ingest_stream(files: DataFrame, store: Store, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the documents of a stream of files (filename, content, file_size_bytes) that aren't stored yet.

    A document id is the digest of the content, and each batch is checked against the table, so a batch that is run again adds nothing.
    No state is kept but the table itself.
    """
    none = store.spark.createDataFrame([], "filename string, company string, fiscal_year int")

    def write(batch: DataFrame, _: int) -> None:
        store.append("documents", ingest(batch, store.read("documents").select("document_id"), none))

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def call_windows(calls: DataFrame, window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """(start, model, calls, mean_latency_ms): calls by event time; calls up to ``late`` behind count, repeated deliveries once.

    Works on a stream and on a table.
    """
    x = calls.select("call_id", "model", F.col("called_at").cast("timestamp").alias("called_at"), "latency_ms").where("called_at IS NOT NULL")
    x = x.withWatermark("called_at", late).dropDuplicates(["call_id", "called_at"]) if x.isStreaming else x.dropDuplicates(["call_id", "called_at"])
    measured = F.when(~F.isnan("latency_ms") & (F.col("latency_ms") >= 0), F.col("latency_ms"))
    out = x.groupBy(F.window("called_at", window).alias("w"), "model").agg(F.count(F.lit(1)).alias("calls"), F.avg(measured).alias("mean_latency_ms"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "model", "calls", "mean_latency_ms")
