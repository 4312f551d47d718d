import datetime as dt
import random

import numpy as np
import pytest

from docmetrics.llm import quantiles as q

CALL = "call_id bigint, experiment_id string, provider string, model string, latency_ms double, called_at timestamp_ntz"


def calls(spark, rows):
    return spark.createDataFrame([(i, "e", p, m, v, dt.datetime(2024, 1, 1 + day)) for i, p, m, v, day in rows], CALL)


@pytest.mark.parametrize("shape", ["lognormal", "uniform", "rising", "ties"])
def test_rank_error_holds_whatever_the_order_of_merging(shape):
    rng = np.random.default_rng(5)
    n = 300_000
    values = {"lognormal": rng.lognormal(6, 2, n), "uniform": rng.random(n), "rising": np.arange(n, dtype=float), "ties": rng.integers(0, 50, n).astype(float)}[shape]
    parts = []
    for part in np.array_split(values, 37):
        s = q.Sketch()
        s.add(part)
        parts.append(q.Sketch.from_bytes(s.to_bytes()))
    random.Random(len(shape)).shuffle(parts)
    while len(parts) > 1:  # a tree of merges
        a, b = parts.pop(), parts.pop(0)
        a.merge(b)
        parts.insert(len(parts) // 2, a)
    whole, ordered = parts[0], np.sort(values)
    assert whole.n == n and whole.points()[1][-1] == n
    for p in (0.1, 0.5, 0.9, 0.99, 0.999):
        x = whole.quantiles((p,))[0]
        low, high = np.searchsorted(ordered, x, "left") / n, np.searchsorted(ordered, x, "right") / n
        assert max(0.0, low - p, p - high) <= q.rank_error(p) + 1 / n
    assert len(whole.to_bytes()) < 100_000


def test_small_groups_are_exact_and_repeats_count_once(spark):
    rows = [(i, "a", "m", float(i), 0) for i in range(1, 102)]
    df = calls(spark, [*rows, *rows[:30]])
    got = {r.q: r.estimate for r in q.percentiles(q.group_sketches(df), ["provider", "model"]).collect()}
    assert got[0.5] == 51.0 and got[0.99] == 100.0
    ranks = {r.call_id: r["rank"] for r in q.ranks(df).collect()}
    assert len(ranks) == 101 and ranks[51] == pytest.approx(51 / 101)
    assert all(r.within for r in q.bounds(df).collect())


def test_nulls_markers_and_missing_providers(spark):
    rows = [(1, " Corvid ", "m", 5.0, 0), (2, None, "m", 7.0, 1), (None, "corvid", "m", 9.0, 0), (None, "corvid", "m", 9.0, 0), (3, "corvid", "m", None, 0), (4, "corvid", "m", float("nan"), 0), (5, "corvid", "m", -1.0, 0), (6, None, None, 1.0, 0)]
    df = calls(spark, rows)
    groups = {(r.provider, r.model): r.n for r in q.group_sketches(df).collect()}
    assert groups == {("corvid", "m"): 4, (None, None): 1}
    ranks = [(r.call_id, r.provider, r["rank"]) for r in q.ranks(df).collect()]
    assert sorted(ranks, key=str) == sorted([(1, "corvid", 0.25), (2, "corvid", 0.5), (None, "corvid", 1.0), (None, "corvid", 1.0), (6, None, 1.0)], key=str)


def test_sketches_go_out_in_loads(spark, monkeypatch):
    df = calls(spark, [(i, f"p{i % 4}", f"m{i % 4}", float(i), 0) for i in range(40)])
    monkeypatch.setattr(q, "SHIPPED", 10)
    assert len(q.ranks(df).collect()) == 40


def test_no_calls(spark):
    df = calls(spark, [])
    assert q.ranks(df).collect() == [] and q.percentiles(q.daily_sketches(df), ["provider", "model", "day"]).collect() == []
