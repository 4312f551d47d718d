"""Problem 1: percentiles of very large numeric columns by mergeable sketches with multiplicative rank error."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from docmetrics.operators.ranks import order_statistics
from docmetrics.session import cut

#: Section size of the compactors.  See :func:`rank_error` for the bound it gives.
SECTION = 64
QUANTILES = (0.5, 0.9, 0.95, 0.99, 0.999)
SALT = 16
#: Values that one task holds in sketches before it hands them on.
HELD = 4_000_000
#: Bytes of sketches that go to every worker at once.
SHIPPED = 64 << 20


def rank_error(q: float, section: int = SECTION) -> float:
    """Bound of a rank's error as a share of all values: three standard deviations.

    A compactor of section size k whose values stand for weight w adds at most w to the rank of a value in its compacted part, with
    a fair sign, and the tail beyond the protected half adds nothing.  Summed over the levels this has a standard deviation of c / k of the
    share of values above, 1 - q.  c = 0.37 is a cautious choice: public implementations of this sketch with three first sections state
    sqrt(0.0512 / 3) = 0.13.  tests/llm/test_p1_quantiles.py holds sketches of 300,000 lognormal, uniform, rising and tied values, merged from 37 parts in
    random order, against the bound.
    """
    return 3 * 0.37 / section * (1 - q) + 1e-12


class Compactor:
    """One level: a buffer whose highest values are protected.

    When it is full, its lowest part is sorted and every other value of it moves up a level, with twice the weight.  How much of
    the buffer takes part follows the count of compactions (the trailing ones of ``state``), so that values near the protected
    tail are seldom compacted; sections grow in number and shrink in size as compactions pass.
    """

    __slots__ = ("section", "sections", "size", "state", "values")

    def __init__(self, section: int) -> None:
        self.section, self.size, self.sections, self.state = float(section), section, 3, 0
        self.values = np.empty(0)

    @property
    def capacity(self) -> int:
        return 2 * self.sections * self.size

    def compact(self, coin: int) -> np.ndarray:
        values = np.sort(self.values)
        ones = 0
        while self.state >> ones & 1:
            ones += 1
        part = min(ones + 1, self.sections)
        keep = self.capacity // 2 + (self.sections - part) * self.size
        cut = max(0, len(values) - keep)
        cut -= cut & 1
        up, self.values = values[coin:cut:2], values[cut:]
        self.state += 1
        if self.state >= 1 << (self.sections - 1) and self.size > 4:
            self.section /= 2**0.5
            self.size, self.sections = max(4, 2 * round(self.section / 2)), self.sections * 2
        return up


class Sketch:
    """Levels of compactors; values of level k stand for 2**k values each.  Small inputs stay exact."""

    def __init__(self, section: int = SECTION) -> None:
        self.section, self.n, self.levels = section, 0, [Compactor(section)]
        self.least, self.most = np.inf, -np.inf

    def _coin(self, level: int, state: int) -> int:
        """A fair coin that depends on the sketch's history alone: a retried task gives the same sketch."""
        x = (self.n * 0x9E3779B97F4A7C15 + level * 0xBF58476D1CE4E5B9 + (state >> 1) * 0x94D049BB133111EB) & (2**64 - 1)
        x ^= x >> 31
        x = x * 0xD6E8FEB86659FD93 & (2**64 - 1)
        return (x >> 40 ^ state) & 1  # the second of two compactions takes the other half

    def _compress(self) -> None:
        level = 0
        while level < len(self.levels):
            c = self.levels[level]
            while len(c.values) >= c.capacity:
                before = len(c.values)
                up = c.compact(self._coin(level, c.state))
                if level + 1 == len(self.levels):
                    self.levels.append(Compactor(self.section))
                above = self.levels[level + 1]
                above.values = np.concatenate([above.values, up])
                if len(c.values) == before:
                    break
            level += 1

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self.least, self.most = min(self.least, float(values.min())), max(self.most, float(values.max()))
        step = 8192
        for i in range(0, len(values), step):
            self.levels[0].values = np.concatenate([self.levels[0].values, values[i : i + step]])
            self._compress()

    def merge(self, other: "Sketch") -> None:
        if not other.n:
            return
        self.n += other.n
        self.least, self.most = min(self.least, other.least), max(self.most, other.most)
        while len(self.levels) < len(other.levels):
            self.levels.append(Compactor(self.section))
        for mine, theirs in zip(self.levels, other.levels):
            mine.values = np.concatenate([mine.values, theirs.values])
            mine.state |= theirs.state
            if theirs.sections > mine.sections:
                mine.section, mine.size, mine.sections = theirs.section, theirs.size, theirs.sections
        self._compress()

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """The held values in order, and how many of all values are estimated to be at most each of them."""
        values = np.concatenate([c.values for c in self.levels])
        weights = np.concatenate([np.full(len(c.values), 1 << k, dtype=np.int64) for k, c in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def quantiles(self, qs: tuple[float, ...]) -> list[float | None]:
        """The least value whose rank reaches q * n."""
        if not self.n:
            return [None] * len(qs)
        values, ranks = self.points()
        at = np.searchsorted(ranks, [max(1, int(np.ceil(q * ranks[-1] - 1e-9))) for q in qs])
        return [float(v) for v in values[np.minimum(at, len(values) - 1)]]

    def to_bytes(self) -> bytes:
        head = struct.pack("<iqddi", self.section, self.n, self.least, self.most, len(self.levels))
        body = b"".join(struct.pack("<diiqi", c.section, c.size, c.sections, c.state, len(c.values)) + c.values.astype("<f8").tobytes() for c in self.levels)
        return head + body

    @classmethod
    def from_bytes(cls, data: bytes) -> "Sketch":
        section, n, least, most, count = struct.unpack_from("<iqddi", data)
        at, out = struct.calcsize("<iqddi"), cls(section)
        out.n, out.least, out.most, out.levels = n, least, most, []
        for _ in range(count):
            c = Compactor(section)
            c.section, c.size, c.sections, c.state, k = struct.unpack_from("<diiqi", data, at)
            at += struct.calcsize("<diiqi")
            c.values = np.frombuffer(data, "<f8", k, at).astype(float)
            at += 8 * k
            out.levels.append(c)
        return out


def local_sketches(df: DataFrame, keys: list[str], value: str, section: int = SECTION) -> DataFrame:
    """(keys, n, sketch): sketches of each group from each task, so that a group of any size leaves a task as small rows.

    Null, NaN, infinite and negative values don't count (-1 marks calls without a measurement); null keys are groups of their own.
    A task with very many groups hands on what it holds whenever that is HELD values.
    """
    base = df.select(*[F.col(k).alias(k) for k in keys], F.col(value).cast("double").alias("_v"))
    base = base.where(F.col("_v").isNotNull() & ~F.isnan("_v") & F.col("_v").between(0, 1.7e308))
    names = [f"{f.name} {f.dataType.simpleString()}" for f in base.schema[:-1]]

    def rows(held: dict[tuple, Sketch]) -> pd.DataFrame:
        return pd.DataFrame([(*group, s.n, s.to_bytes()) for group, s in held.items()], columns=[*keys, "n", "sketch"])

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, Sketch] = {}
        count = 0
        for pdf in batches:
            values = pdf["_v"].to_numpy(float)
            for group, at in pdf.groupby(keys, dropna=False, sort=False).indices.items():
                group = tuple(None if pd.isna(g) else g for g in (group if isinstance(group, tuple) else (group,)))
                if group not in held:
                    held[group] = Sketch(section)
                held[group].add(values[at])
            count += len(pdf)
            if count >= HELD and sum(len(c.values) for s in held.values() for c in s.levels) >= HELD:
                yield rows(held)
                held, count = {}, 0
        if held:
            yield rows(held)

    return base.mapInPandas(local, ", ".join([*names, "n bigint", "sketch binary"]))


def sketches(df: DataFrame, keys: list[str], value: str, section: int = SECTION) -> DataFrame:
    """(keys, n, sketch): one sketch per group, storable and mergeable with those of other days or loads.

    The tasks' sketches of a group are merged in two steps, first within a salt; groups without any countable value are left out.
    """
    parts = local_sketches(df, keys, value, section).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALT)))
    return merge(merge(parts, [*keys, "_salt"]), keys)


def daily_sketches(calls: DataFrame, section: int = SECTION) -> DataFrame:
    """(provider, model, day, n, sketch) of calls: what a day's load would store, computed once.

    The calls are read once and shuffled once, by id; a day or model of any size is spread over all tasks and leaves each as one small sketch.  A
    missing provider is that of the other measured calls of the model if they agree on one, otherwise it stays null: settled
    between sketches, not calls.
    """
    keys = ["provider", "model", "day"]
    parts = cut(sketches(measured_calls(calls), keys, "latency_ms", section))
    named = parts.where("provider IS NOT NULL AND model IS NOT NULL").groupBy("model").agg(F.min("provider").alias("_p"), F.max("provider").alias("_q"))
    owners = named.where("_p = _q").select("model", F.col("_p").alias("_owner"))
    filled = parts.join(owners, "model", "left").select(F.coalesce("provider", "_owner").alias("provider"), "model", "day", "sketch")
    return merge(filled, keys)


def combined(daily: DataFrame) -> DataFrame:
    """(provider, model, n, sketch): all days combined, month by month."""
    monthly = merge(daily.withColumn("_month", F.trunc("day", "month")), ["provider", "model", "_month"])
    return merge(monthly, ["provider", "model"])


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, sketch): the sketches of each group combined into one."""

    @F.pandas_udf("binary")
    def merged(data: pd.Series) -> bytes:
        out = Sketch.from_bytes(data.iloc[0])
        for d in data.iloc[1:]:
            out.merge(Sketch.from_bytes(d))
        return out.to_bytes()

    grouped = parts.groupBy(*keys).agg(merged("sketch").alias("sketch"))

    @F.pandas_udf("bigint")
    def count(data: pd.Series) -> pd.Series:
        return data.map(lambda d: struct.unpack_from("<iq", d)[1])

    return grouped.select(*keys, count("sketch").alias("n"), "sketch")


def percentiles(parts: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(keys, n, q, estimate): percentiles of each group's sketch."""

    @F.pandas_udf("array<double>")
    def values(data: pd.Series) -> pd.Series:
        return data.map(lambda d: Sketch.from_bytes(d).quantiles(quantiles))

    out = parts.select(*keys, "n", values("sketch").alias("_e")).select(*keys, "n", F.posexplode("_e").alias("_i", "estimate"))
    return out.select(*keys, "n", F.get(F.array(*[F.lit(float(q)) for q in quantiles]), F.col("_i")).alias("q"), "estimate")


def provider_name(provider: Column) -> Column:
    """One writing of a provider's name; null stays null."""
    return F.lower(F.trim(provider))


def measured_calls(calls: DataFrame) -> DataFrame:
    """(call_id, provider, model, day, latency_ms): each call once, with one writing of its provider.

    A call delivered twice is the same in every column and counts once; calls without an id all count.  The one shuffle is by all columns,
    so no value of any of them makes a task hot.
    """
    day = F.to_date("called_at").alias("day")
    base = calls.select("call_id", provider_name(F.col("provider")).alias("provider"), "model", day, "latency_ms")
    own = F.when(F.col("call_id").isNull(), F.monotonically_increasing_id()).alias("_own")
    return base.select("*", own).distinct().drop("_own")


def group_sketches(calls: DataFrame) -> DataFrame:
    """(provider, model, n, sketch) over all days."""
    return combined(daily_sketches(calls))


def ranks(calls: DataFrame) -> DataFrame:
    """(call_id, provider, model, latency_ms, rank): each measured call with the estimated share of its group's calls that are at most as slow.

    The error of a rank is bounded by :func:`rank_error`.  The groups' sketches go to the workers in loads of at most SHIPPED bytes, each of which meets all calls
    of its groups in one narrow pass; a group's calls are never brought together.  Providers are filled in as in :func:`daily_sketches`.
    """
    parts = group_sketches(calls).withColumn("_b", F.length("sketch"))
    sole = parts.where("provider IS NOT NULL AND model IS NOT NULL").groupBy("model").agg((F.min("provider") == F.max("provider")).alias("sole"))
    before = F.sum("_b").over(Window.orderBy("model", "provider")) - F.col("_b")  # over a row for each group
    parts = cut(parts.join(sole, "model", "left").select("provider", "model", "sketch", F.coalesce("sole", F.lit(False)).alias("sole"), F.floor(before / SHIPPED).alias("load")))
    once = measured_calls(calls).where(F.col("latency_ms").between(0, 1.7e308)).drop("day")
    schema = T.StructType([*once.schema, T.StructField("rank", T.DoubleType())])
    out = once.sparkSession.createDataFrame([], schema)
    for load in range((parts.agg(F.max("load")).first()[0] or 0) + 1):
        part = _ranked(once, parts.where(F.col("load") == load).drop("load").collect(), schema)  # at most SHIPPED bytes and one sketch
        out = out.unionByName(part) if load else part
    return out


def _ranked(calls: DataFrame, sketches: list, schema: T.StructType) -> DataFrame:
    shipped = calls.sparkSession.sparkContext.broadcast([(r.provider, r.model, bytes(r.sketch), r.sole) for r in sketches])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points = {(p, m): Sketch.from_bytes(v).points() for p, m, v, _ in shipped.value}
        owner = {m: p for p, m, _, sole in shipped.value if sole}
        for pdf in batches:
            out = []
            for (provider, model), rows in pdf.groupby(["provider", "model"], dropna=False, sort=False):
                model = None if pd.isna(model) else model
                provider = owner.get(model) if pd.isna(provider) else provider
                if (provider, model) in points:
                    values, counts = points[provider, model]
                    at = np.searchsorted(values, rows["latency_ms"].to_numpy(float), side="right")
                    out.append(rows.assign(provider=provider, rank=np.where(at > 0, counts[np.maximum(at, 1) - 1], 0) / counts[-1]))
            yield pd.concat(out) if out else pdf.assign(rank=0.0)[:0]

    return calls.mapInPandas(run, schema)


def bounds(calls: DataFrame, quantiles: tuple[float, ...] = QUANTILES, section: int = SECTION) -> DataFrame:
    """(provider, model, q, n, within): whether each estimated percentile lies between the exact values at the ranks that :func:`rank_error` allows.

    The exact values are those of :func:`docmetrics.operators.ranks.order_statistics`, which sorts no group in one task.
    """
    found = percentiles(group_sketches(calls), ["provider", "model"], quantiles)
    n, margin = F.col("n"), rank_error(0.0, section)
    wanted = {}
    for i, q in enumerate(quantiles):
        slack = margin * (1 - q)
        wanted[f"low{i}"] = F.greatest(F.lit(0), F.ceil(n * (q - slack)) - 1)
        wanted[f"high{i}"] = F.least(n - 1, F.greatest(F.lit(0), F.ceil(n * (q + slack)) - 1))
    exact = order_statistics(ranks(calls), ["provider", "model"], "latency_ms", wanted)
    rows = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high")) for i, q in enumerate(quantiles)])
    exact = exact.select(F.col("provider").alias("_p"), F.col("model").alias("_m"), F.inline(rows))
    met = found.join(exact, found["provider"].eqNullSafe(exact["_p"]) & found["model"].eqNullSafe(exact["_m"]) & (found["q"] == exact["q"]))
    return met.select("provider", "model", found["q"], "n", F.col("estimate").between(F.col("low"), F.col("high")).alias("within"))
