"""What model calls cost, by a table of prices."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from docmetrics.session import small

PRICES = "key string, ordinal int, input_per_million double, output_per_million double"


def read_prices(spark: SparkSession, path: str | Path) -> DataFrame:
    """(key, ordinal, input_per_million, output_per_million) from a YAML file with ``models``; a missing file gives no prices."""
    import yaml

    models = (yaml.safe_load(Path(path).read_text()) or {}).get("models") or {} if Path(path).exists() else {}
    rows = [(k, i, float(p["input_cost_per_1m_tokens"]), float(p["output_cost_per_1m_tokens"])) for i, (k, p) in enumerate(models.items())]
    return spark.createDataFrame(rows, PRICES)


def matched_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, key, input_per_million, output_per_million): the price of each distinct model, null where none fits.

    The exact key, else the first in order of which one begins with the other.  Only distinct models meet the prices, so the nested loop is
    over two short lists whatever the number of calls.
    """
    some = models.select("model").distinct()
    fits = F.col("model").startswith(F.col("key")) | F.col("key").startswith(F.col("model"))
    rank = F.when(F.col("model") == F.col("key"), -1).otherwise(F.col("ordinal"))
    best = some.join(prices, fits, "left").groupBy("model").agg(F.min_by(F.struct("key", "input_per_million", "output_per_million"), rank).alias("p"))
    return best.select("model", "p.*")


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Each call with price_key, priced and cost_usd.

    A call without either token count has no usage and no cost; one missing count is 0.  Without a price the cost is null.
    """
    by_model = small(matched_prices(calls.where("model IS NOT NULL"), prices).select("model", F.col("key").alias("price_key"), "input_per_million", "output_per_million"))  # a row for each model
    tokens = [F.coalesce(F.col(c), F.lit(0)) for c in ("input_tokens", "output_tokens")]
    cost = tokens[0] / 1_000_000 * F.col("input_per_million") + tokens[1] / 1_000_000 * F.col("output_per_million")
    used = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    out = calls.join(by_model, "model", "left")
    return out.withColumns({"priced": used & F.col("price_key").isNotNull(), "cost_usd": F.when(used, cost)}).drop("input_per_million", "output_per_million")


def cost_rollup(costs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, calls, input_tokens, output_tokens, cost_known_usd, cost_usd): cost_known_usd is null if nothing is known; cost_usd also if it is zero."""
    total = F.sum("cost_usd")
    return costs.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), total.alias("cost_known_usd"), F.when(total > 0, total).alias("cost_usd"))
