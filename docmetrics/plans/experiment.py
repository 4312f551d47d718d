"""A whole run over documents: contexts, replies, metrics, evaluation, figures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from docmetrics import providers
from docmetrics.operators import context, cost, evaluate, extract, metrics, provenance, validate
from docmetrics.schemas import PIPELINES
from docmetrics.session import cut


@dataclass
class Experiment:
    """One run of ``pipelines`` over documents; every stage is a frame that is computed when it is first used.

    ``documents`` has document_id, company and fiscal_year; a year outside of 1900 to 2100 can't have a report and is left out of the runs
    (:attr:`rejected` has them).  Pages, blocks and tables are those of the parsers; ``records`` the known values; ``prices`` those of
    :mod:`docmetrics.operators.cost`.
    """

    documents: DataFrame
    pages: DataFrame
    blocks: DataFrame
    tables: DataFrame
    records: DataFrame
    prices: DataFrame
    pipelines: list[str] = field(default_factory=lambda: list(PIPELINES))
    provider: str | Callable[[], providers.Provider] = "mock"
    order: str = "gt_id"

    @cached_property
    def _sound(self) -> DataFrame:
        return self.documents.where("document_id IS NOT NULL AND fiscal_year BETWEEN 1900 AND 2100").groupBy("document_id").agg(F.min(F.struct("company", "fiscal_year")).alias("d")).select("document_id", "d.*")

    @cached_property
    def rejected(self) -> DataFrame:
        return self.documents.where("document_id IS NULL OR fiscal_year IS NULL OR fiscal_year NOT BETWEEN 1900 AND 2100")

    @cached_property
    def _pages(self) -> DataFrame:
        return context.latest_pages(self.pages)

    @cached_property
    def contexts(self) -> DataFrame:
        parsed = self._pages.join(self._sound.select("document_id"), "document_id", "left_semi")
        return context.contexts(parsed, self.tables, self.pipelines)

    @cached_property
    def calls(self) -> DataFrame:
        """Replies, written once: later stages must not call a model again."""
        return cut(providers.replies(self.contexts, self.provider))

    @cached_property
    def metrics(self) -> DataFrame:
        """Seven rows per readable reply."""
        return extract.json_metrics(self.calls.select("document_id", "pipeline", "text"))

    @cached_property
    def reports(self) -> DataFrame:
        """(document_id, pipeline, company, fiscal_year, extracted, coverage, status, errors) of every call; without a readable reply it is invalid.

        Reports of ``hybrid`` carry the warnings of the consistency checks among their errors.
        """
        keys = ["document_id", "pipeline"]
        made = extract.reports(self.metrics, keys)
        warned = validate.consistency(self.metrics.where("pipeline = 'hybrid'"), keys)
        out = self.calls.select(*keys).join(made, keys, "left").join(warned, keys, "left").join(self._sound, "document_id")
        none = F.array().cast("array<string>")
        errors = F.concat(F.coalesce("errors", F.array(F.lit("the reply isn't a JSON object"))), F.coalesce("warnings", none))
        return out.select(*keys, "company", "fiscal_year", F.coalesce("extracted", F.lit(0)).alias("extracted"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("status", F.lit("invalid")).alias("status"), errors.alias("errors"))

    @cached_property
    def provenance(self) -> DataFrame:
        return provenance.provenance(self.metrics, self.calls, self._pages, self.blocks)

    @cached_property
    def results(self) -> DataFrame:
        """Field results of the reports with a known row."""
        run = F.struct("document_id", "pipeline").alias("run_id")
        runs = self.reports.select(run, "document_id", "pipeline", "company", "fiscal_year")
        return evaluate.field_results(runs, self.metrics.select(run, "field_name", "value", "unit"), self.records, self.order)

    @cached_property
    def failures(self) -> DataFrame:
        return evaluate.failures(self.results)

    @cached_property
    def costs(self) -> DataFrame:
        """Calls with cost_usd, and cost_per_field_usd, the call's cost once for each extracted field (what summing over provenance rows gives)."""
        priced = cost.call_costs(self.calls, self.prices)
        n = self.metrics.where("value IS NOT NULL").groupBy("document_id", "pipeline").agg(F.count(F.lit(1)).alias("_n"))
        return priced.join(n, ["document_id", "pipeline"], "left").withColumn("cost_per_field_usd", F.col("cost_usd") * F.col("_n")).drop("_n", "text")

    @cached_property
    def pipeline_metrics(self) -> DataFrame:
        runs = self.costs.join(self.reports.select("document_id", "pipeline", "status"), ["document_id", "pipeline"])
        return metrics.pipeline_metrics(self.results, runs.select("document_id", "pipeline", "latency_ms", "cost_usd", "status"))

    def summary(self) -> DataFrame:
        return metrics.summary(self.pipeline_metrics)
