from collections import Counter

import pytest

from docmetrics.llm import mixing as m


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, w double")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


@pytest.fixture(scope="module")
def some(spark):
    rows = [(i, "a", "one two three four five " * (1 + i % 5), 1.0 + i % 7) for i in range(300)] + [(1000 + i, "b", "six seven eight " * 20, 1.0) for i in range(20)]
    return docs(spark, [*rows, (5000, None, "no source", 1.0), (5001, "c", "no target", 1.0), (5002, "a", "", 1.0), (5003, "a", None, 1.0)])


def test_shares_and_caps(spark, some):
    mix = m.Mixture(some, targets(spark, [("a", 0.5, 2), ("b", 0.5, 3)]))
    got = {r.source: r for r in mix.shares().collect()}
    assert got["a"].share == pytest.approx(0.5, abs=0.02) and got["b"].share == pytest.approx(0.5, abs=0.02)
    assert got["a"].most_copies <= 2 and got["b"].most_copies <= 3
    ids = {r.doc_id for r in mix.copies().collect()}
    assert not ids & {5000, 5001, 5002, 5003}


def test_a_source_at_its_cap_is_used_wholly(spark, some):
    got = {r.doc_id: r.copies for r in m.Mixture(some, targets(spark, [("a", 0.1, 1), ("b", 0.9, 3)])).copies().collect()}
    assert {got[1000 + i] for i in range(20)} == {3}


def test_the_seed_decides_the_draw(spark, some):
    draw = lambda seed: {r.doc_id for r in m.Mixture(some, targets(spark, [("a", 0.3, 1), ("b", 0.7, 1)]), seed=seed).copies().collect()}
    assert draw(1) == draw(1) != draw(2)


def test_odds_of_inclusion_follow_the_weights(spark):
    same = docs(spark, [(i, "a", "one two three", 1.0 + i % 2 * 2) for i in range(400)])
    seen = Counter()
    for seed in range(6):
        for r in m.Mixture(same, targets(spark, [("a", 1.0, 2)]), seed=seed, total=400 * 3 * 0.25, weight="w").copies().collect():
            seen[r.doc_id % 2] += r.copies
    assert seen[1] / seen[0] == pytest.approx(3.0, rel=0.15)


def test_weights_above_the_cap_are_certain_copies(spark):
    rows = docs(spark, [(i, "a", "one two three", 100.0 if i < 3 else 1.0) for i in range(60)])
    got = {r.doc_id: r.copies for r in m.Mixture(rows, targets(spark, [("a", 1.0, 2)]), total=60 * 3 * 0.5, weight="w").copies().collect()}
    assert [got[i] for i in range(3)] == [2, 2, 2] and max(got.values()) == 2 and sum(got.values()) == pytest.approx(30, abs=1)


def test_uses_per_weight_fills_the_budget():
    cells = [(10.0, 100, 1000.0), (1.0, 500, 500.0)]
    for budget in (50, 200, 400, 900):
        c = m.uses_per_weight(cells, budget, 2.0)
        assert sum(t * min(2.0, c * top) for top, t, _ in cells) == pytest.approx(budget)


def test_no_documents(spark):
    mix = m.Mixture(docs(spark, []), targets(spark, [("a", 1.0, 2)]))
    assert mix.copies().collect() == [] and [r.share for r in mix.shares().collect()] == [0.0]
