"""Exact order statistics of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docmetrics.session import small

#: Cells to a factor of e.
CELLS = 4096


def cell(value: Column) -> Column:
    """A whole number that rises with the value; each cell spans 1/4096 of a factor of e (absolute, near zero)."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * CELLS)).cast("bigint")


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, n, mean, least, most, one column for each rank): exact values at ranks counted from 0.

    ``ranks`` are columns of ``n``, the group's count of values.  A group is never sorted in one task: its values are counted by
    cells (partial counts before the shuffle; the cells of a group are bounded by the range of doubles, not by its rows), and only the few cells
    that hold a wanted rank are resolved, by counts of distinct values.  Null and NaN values don't count; groups without values are left
    out; null keys are a group.
    """
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    base = base.withColumn("_cell", cell(F.col("_v")))
    cells = base.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_sum"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    totals = cells.groupBy(*keys).agg(F.sum("_n").alias("n"), (F.sum("_sum") / F.sum("_n")).alias("mean"), F.min("_least").alias("least"), F.max("_most").alias("most"))
    names = list(ranks)
    wanted = totals.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), ranks[k].cast("bigint").alias("_rank")) for i, k in enumerate(names)])).alias("_w")).select(*keys, "_w.*")
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    placed = cells.select(*keys, "_cell", "_n", before.alias("_before"))
    on = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    held = placed.alias("p").join(wanted.alias("w"), on("p", "w"))
    held = held.where("_rank >= _before AND _rank < _before + _n").select(*[F.col(f"p.{k}").alias(k) for k in keys], "_cell", "_i", (F.col("_rank") - F.col("_before")).alias("_at"))
    held = small(held)  # a few rows for each group; where it is sent, only the wanted cells' values are shuffled
    some = small(held.select(*keys, "_cell").distinct())
    inside = base.alias("b").join(some.alias("s"), [*on("b", "s"), F.col("b._cell") == F.col("s._cell")], "left_semi")
    values = inside.groupBy(*keys, "_cell", "_v").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    values = values.withColumn("_upto", upto)
    found = values.alias("v").join(held.alias("h"), [*on("v", "h"), F.col("v._cell") == F.col("h._cell")]).where("_at >= _upto - _n AND _at < _upto")
    wide = found.groupBy(*[F.col(f"v.{k}").alias(k) for k in keys]).agg(*[F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(k) for i, k in enumerate(names)])
    out = totals.alias("t").join(wide.alias("x"), on("t", "x"))
    return out.select(*[F.col(f"t.{k}").alias(k) for k in keys], "n", "mean", "least", "most", *names)


def latency_stats(df: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """(keys, n, mean, median, p95, least, most).

    The median of an even count is the mean of the two in the middle; p95 is the value at place floor(0.95 n + 0.5), counted from 0,
    at most the last.  Null and NaN latencies don't count.
    """
    n = F.col("n")
    ranks = {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2), "p95": F.least(F.floor(F.lit(0.95) * n + 0.5), n - 1)}
    out = order_statistics(df, keys, value, ranks)
    return out.select(*keys, "n", "mean", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "p95", "least", "most")
