"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docmetrics.llm import leakage, mixing, names, quantiles, scans, skeletons, splitting
from docmetrics.session import table


def p1_ranks(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.ranks(table(spark, d, "llm_calls"))


def p1_bounds(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.bounds(table(spark, d, "llm_calls"))


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(quantiles.group_sketches(table(spark, d, "llm_calls")), ["provider", "model"])


def p1_daily(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(quantiles.daily_sketches(table(spark, d, "llm_calls")), ["provider", "model", "day"], (0.5, 0.99))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_rows(*_names(spark, d))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    return names.name_clusters(*_names(spark, d))


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, d, t) for t in ("filings", "gt_records"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(*_items(spark, d))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(*_items(spark, d))


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, d, t) for t in ("parsed_pages", "parsed_tables", "size_limits"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(table(spark, d, "parsed_pages"), table(spark, d, "text_blocks"))


def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.Scan(table(spark, d, "parsed_pages"), table(spark, d, "text_blocks")).repaired()


def p6_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "parsed_pages"), table(spark, d, "text_blocks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_answers(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_answers(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).copies()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares()


def p8_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Longer documents are used more often."""
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), weight="n_chars").copies()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return skeletons.look_alike_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return skeletons.look_alike_classes(table(spark, d, "documents"))


def p9_texts(spark: SparkSession, d: str) -> DataFrame:
    return skeletons.consistent_texts(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_ranks, p1_percentiles, p1_daily, p1_bounds, p4_found, p4_clusters, p5_found, p5_pieces, p6_found, p6_repaired, p6_paragraphs, p7_found, p7_passages, p7_answers, p8_mixture, p8_shares, p8_weighted, p9_found, p9_classes, p9_texts)}


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can state; the others are tested against brute force in tests/llm."""
    quantile_rows = ", ".join(f"({q})" for q in quantiles.QUANTILES)
    measured = """m AS (SELECT DISTINCT call_id, lower(trim(provider)) AS provider, model, called_at::DATE AS day, latency_ms FROM llm_calls WHERE latency_ms >= 0 AND NOT isnan(latency_ms)),
        o AS (SELECT model, min(provider) AS owner FROM m WHERE provider IS NOT NULL GROUP BY model HAVING min(provider) = max(provider)),
        f AS (SELECT coalesce(m.provider, o.owner) AS provider, m.model, m.call_id, m.latency_ms FROM m LEFT JOIN o USING (model))"""
    rows = "array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(coalesce(r, []), lambda c: coalesce(c, '')), ' | ')), chr(10))"
    return {
        # every estimate lies within its bound, in as many groups and calls as there are
        "p1_bounds": f"WITH {measured} SELECT provider, model, q::DOUBLE AS q, n, true AS within FROM (SELECT provider, model, count(*) AS n FROM f GROUP BY ALL), (VALUES {quantile_rows}) AS v(q)",
        "p5_found": f"""SELECT 'page' AS item_kind, page_id AS item_id FROM parsed_pages, size_limits WHERE item_kind = 'page' AND length(full_text) > max_chars
            UNION ALL SELECT 'table', table_id FROM parsed_tables, size_limits WHERE item_kind = 'table' AND length({rows}) > max_chars""",
    }
