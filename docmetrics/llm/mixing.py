"""Problem 8: combine sources to target shares of the total tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from docmetrics.operators.ranks import cell
from docmetrics.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public splitting pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cells of the rank histogram; only the cell in which a source's budget ends is ranked exactly.
CELLS = 1 << 14
_ENCODERS: dict[str, object] = {}


def _encoder(path: str, data: bytes):  # noqa: ANN202
    """One encoder for each worker."""
    if path not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODERS[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_sizes(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER, weight: str | None = None) -> DataFrame:
    """(doc_id, source, tokens, weight): sizes in tokens; a null or empty text has none.

    The vocabulary file is read here and sent to the workers, which needn't have it: its size, about a megabyte, doesn't depend on the data.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    base = documents.select(F.col(key).alias(key), F.col(source).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("_text"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    schema = T.StructType([base.schema[0], T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer, shipped.value).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "source": pdf["source"], "tokens": pd.Series([len(encode(t)) for t in pdf["_text"]], dtype="int64"), "weight": pdf["weight"]})

    return base.mapInPandas(run, schema)


def _uniform(key: Column, seed: int) -> Column:
    """A uniform number in (0, 1) that only depends on the document and the seed."""
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))


def uses_per_weight(cells: list[tuple[float, int, float]], budget: float, most: float) -> float:
    """The factor c for which all documents together, each used c times its weight but at most ``most`` times, fill the budget.

    ``cells`` are (highest weight, tokens, tokens times weight) of documents of nearly the same weight.  The heaviest ones reach the cap first; what
    they can't take goes to the others.
    """
    left, weighted = budget, sum(w for _, _, w in cells)
    for top, tokens, w in sorted(cells, reverse=True):
        c = left / weighted if weighted > 0 else 0.0
        if c * top <= most:
            return c
        left, weighted = left - tokens * most, weighted - w
    return most / min((top for top, _, _ in cells), default=1.0)


class Mixture:
    """Sizes, budgets and copies of one mixture, each computed once.

    The total is the largest one that every source can fill to its share with at most ``max_repeats`` uses of a document
    (or ``total``, if less).  A source's budget gives each of its documents a number of uses: the same one, or in proportion to ``weight``, never above
    ``max_repeats``.  The whole part of it are certain copies.  What is left over is a Pareto sample: documents rank by their random odds
    divided by their odds of inclusion, the fraction of their number of uses, and the least ranks are taken until the budget is met to the nearest document.
    ``seed`` decides the random odds.  Documents of sources without a target (a null source too), null keys and empty texts get no copy; so do weights that
    are null or not positive.  Sources without any token are left out and the other shares are raised in proportion.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 8, total: float | None = None, tokenizer: str = TOKENIZER, weight: str | None = None) -> None:
        self.key, self.seed = key, seed
        self.targets = targets.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
        wanted = documents.join(F.broadcast(self.targets.select("source")), "source", "left_semi").where(F.col(key).isNotNull())  # a row for each source
        self.sizes = cut(token_sizes(wanted, key, tokenizer=tokenizer, weight=weight).where("tokens > 0 AND weight > 0"))
        have = self.sizes.groupBy("source", cell(F.col("weight")).alias("cell")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("weight")).alias("weighted"), F.max("weight").alias("top"))
        cells: dict[str, list] = {}
        for r in have.collect():  # bounded by the sources and the range of weights
            cells.setdefault(r.source, []).append((r.top, r.tokens, r.weighted))
        rows = [r for r in self.targets.collect() if r.source in cells]  # one for each source
        shares = sum(r.target_share for r in rows) or 1.0
        tokens = {s: sum(t for _, t, _ in c) for s, c in cells.items()}
        most = min((tokens[r.source] * max(0, r.max_repeats) / (r.target_share / shares) for r in rows), default=0.0)
        self.total = min(most, total) if total else most
        self.plan = [(r.source, self.total * r.target_share / shares, uses_per_weight(cells[r.source], self.total * r.target_share / shares, max(0, r.max_repeats)), float(max(0, r.max_repeats))) for r in rows]

    def copies(self) -> DataFrame:
        """(doc_id, source, tokens, copies) of every document that is used."""
        plan = F.broadcast(self.sizes.sparkSession.createDataFrame(self.plan, "source string, budget double, per_weight double, most double"))  # a row for each source
        uses = F.least(F.col("most"), F.col("per_weight") * F.col("weight"))
        whole = F.floor(uses + 1e-9)
        docs = self.sizes.join(plan, "source").withColumns({"whole": whole.cast("int"), "part": F.greatest(F.lit(0.0), uses - whole)})
        u = _uniform(F.col(self.key), self.seed)
        odds = (u / (1 - u)) * (1 - F.col("part")) / F.greatest(F.col("part"), F.lit(1e-12))
        ranked = docs.withColumn("rank", F.when(F.col("part") > 1e-12, odds / (1 + odds)))
        ranked = ranked.withColumn("cell", F.when(F.col("rank").isNotNull(), F.least(F.floor(F.col("rank") * CELLS), F.lit(CELLS - 1))))
        certain = docs.groupBy("source").agg((F.max("budget") - F.sum(F.col("tokens") * F.col("whole"))).alias("rest"))
        cells = ranked.where("rank IS NOT NULL").groupBy("source", "cell").agg(F.sum("tokens").alias("t")).join(F.broadcast(certain), "source")  # a row for each source
        before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cells = cells.withColumn("before", before)  # at most CELLS rows for each source
        ends = cells.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest")))
        ends = F.broadcast(ends.select("source", F.col("cell").alias("last"), (F.col("rest") - F.col("before")).alias("left")))
        out = ranked.join(ends, "source", "left")
        inner = out.where("cell = last").withColumn("_sum", F.sum("tokens").over(Window.partitionBy("source").orderBy("rank", self.key)))
        edge = inner.select(self.key, "source", "tokens", (F.col("whole") + (F.col("_sum") - F.col("tokens") / 2 <= F.col("left")).cast("int")).alias("copies"))
        drawn = F.col("cell").isNotNull() & (F.col("last").isNull() | (F.col("cell") < F.col("last")))
        rest = out.where("last IS NULL OR cell IS NULL OR cell <> last").select(self.key, "source", "tokens", (F.col("whole") + drawn.cast("int")).alias("copies"))
        return rest.unionByName(edge).where("copies > 0")

    def shares(self) -> DataFrame:
        """(source, target_share, max_repeats, documents, tokens, most_copies, share): what each source reached; sources without documents reach 0."""
        used = self.copies().groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
        all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over a row for each source
        out = self.targets.join(used, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
        return out.withColumn("share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), all_tokens), F.lit(0.0)))
