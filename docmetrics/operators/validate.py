"""Checks of metrics, reports and provenance rows.  Each gives an array of what is wrong, empty for sound rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docmetrics.functions.normalize import is_valid_value
from docmetrics.functions.text import strip
from docmetrics.schemas import MAX_SOURCE_TEXT


def _wrong(**checks: Column) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))


def _false(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def metric_errors(value: Column, currency: Column, bbox: Column, confidence: Column, page: Column, source_text: Column) -> Column:
    """value (null, NaN or infinite), currency (not three letters), bbox (not four numbers, or turned round), confidence (outside of 0 to 1), page (below 1), source_text (over 2,000 code points).

    Null is fine for everything but the value; NaN as a confidence is not.
    """
    x = [F.get(bbox, F.lit(i)) for i in range(4)]
    return _wrong(
        value=~_false(is_valid_value(value)),
        currency=_false(~F.upper(strip(currency)).rlike("^[A-Z]{3}$")),
        bbox=_false((F.size(bbox) != 4) & bbox.isNotNull()) | _false((x[0] >= x[2]) | (x[1] >= x[3])),
        confidence=_false(~confidence.between(0, 1) | F.isnan(confidence)),
        page=_false(page < 1),
        source_text=_false(F.length(source_text) > MAX_SOURCE_TEXT),
    )


def fiscal_year(raw: Column) -> Column:
    """The year of a string of four digits from 1900 to 2100, else null."""
    year = strip(raw)
    number = F.when(year.rlike("^[0-9]{4}$"), year.try_cast("int"))
    return F.when(number.between(1900, 2100), number)


def provenance_errors(input_tokens: Column, output_tokens: Column, cost: Column, confidence: Column, *times: Column) -> Column:
    """tokens or cost below 0, a confidence outside of 0 to 1, a stage time below 0."""
    late = F.lit(False)
    for t in times:
        late = late | _false(t < 0)
    return _wrong(tokens=_false(input_tokens < 0) | _false(output_tokens < 0), cost=_false(cost < 0), confidence=_false(~confidence.between(0, 1) | F.isnan(confidence)), time=late)


def consistency_warnings(revenue: Column, operating_income: Column, total_assets: Column, total_liabilities: Column) -> Column:
    """operating_income above a positive revenue, liabilities above positive assets, a revenue that isn't positive; null values give no warning."""
    return _wrong(
        operating_income_above_revenue=_false((revenue > 0) & (operating_income > revenue)),
        liabilities_above_assets=_false((total_assets > 0) & (total_liabilities > total_assets)),
        revenue_not_positive=_false(revenue <= 0),
    )


def consistency(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, warnings) of every report, from its metrics in long form; of repeated fields the highest value counts."""
    fields = ["revenue", "operating_income", "total_assets", "total_liabilities"]
    wide = metrics.groupBy(*keys).agg(*[F.max(F.when((F.col("field_name") == f) & ~F.isnan("value"), F.col("value"))).alias(f) for f in fields])
    return wide.select(*keys, consistency_warnings(*[F.col(f) for f in fields]).alias("warnings"))
