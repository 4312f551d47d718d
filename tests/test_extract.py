import json

import pytest

from docmetrics.operators import context as c, cost, extract as x, provenance as p, validate as v
from pyspark.sql import functions as F

PAGE = "page_id bigint, document_id string, page_number int, full_text string"
TABLE = "table_id bigint, document_id string, page int, table_index int, rows array<array<string>>"
BLOCK = "document_id string, page int, block_index int, text string, bbox array<double>"


def pages(spark, *rows):
    return c.latest_pages(spark.createDataFrame(rows, PAGE))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_the_latest_delivery_of_a_page_counts(spark):
    got = pages(spark, (1, "d", 1, "old"), (5, "d", 1, "new"), (2, "d", 2, None), (3, None, 1, "x"), (4, "d", None, "y")).orderBy("page_number").collect()
    assert [(r.page_number, r.text) for r in got] == [(1, "new"), (2, "")]


def test_text_context(spark):
    df = pages(spark, (1, "a", 2, "Total Assets 5"), (2, "a", 1, "cover"), (3, "a", 10, "REVENUE 7"), (4, "b", 2, "two"), (5, "b", 1, "one"))
    got = {r.document_id: r.context for r in c.text_context(df).collect()}
    assert got == {"a": "Total Assets 5" + c.BREAK + "REVENUE 7", "b": "one" + c.BREAK + "two"}
    assert {tuple(r) for r in c.keyword_pages(df).collect()} == {("a", 2), ("a", 10)}
    assert {r.document_id: r.text for r in c.all_text(df).collect()}["a"] == "cover\nTotal Assets 5\nREVENUE 7"


def test_contexts_are_cut_at_the_limit(spark):
    rows = [(i, "a", i, f"page {i} revenue " + "x" * 700) for i in range(1, 60)] + [(100, "b", 1, "y" * 30000)]
    df = pages(spark, *rows)
    got = {r.document_id: r.context for r in c.text_context(df).collect()}
    assert got["a"] == c.BREAK.join(t for _, _, _, t in rows[:-1])[:12000] and got["b"] == "y" * 12000
    assert c.text_context(pages(spark)).collect() == []


def tables(spark, *rows):
    return spark.createDataFrame(rows, TABLE)


def test_layout_context(spark):
    df = pages(spark, (1, "a", 1, "h" * 400), (2, "a", 2, "  \n"), (3, "b", 1, "revenue"))
    grids = tables(spark, (1, "a", 1, 0, [["Revenue", "5"]]), (2, "a", 1, 1, [["Net income", None]]), (3, "a", 2, 0, [["total assets"]]), (4, "a", 1, 2, [["other"]]), (5, "b", 1, 0, [["x"]]))
    got = {r.document_id: r.context for r in c.layout_context(df, grids).collect()}
    head = "[Page 1 context]\n" + "h" * 300
    assert got["a"] == "\n\n".join([head, "[Table on page 1]\n| Revenue | 5 |", head, "[Table on page 1]\n| Net income |  |", "[Table on page 2]\n| total assets |"])
    assert got["b"] == "revenue"


def test_hybrid_context(spark):
    df = pages(spark, (1, "a", 1, "first page"), (2, "a", 2, "revenue " + "z" * 3000), (3, "a", 3, "nothing"))
    grids = tables(spark, (1, "a", 1, 0, [["Revenue", "5"]]), (2, "a", 1, 1, [["Net sales", "6"]]))
    got = one(c.hybrid_context(df, grids)).context
    assert got == "\n\n".join(["[Page 1 — full text]\nfirst page", "[Table on page 1]\n| Revenue | 5 |", "[Table on page 1]\n| Net sales | 6 |", "[Page 2]\n" + ("revenue " + "z" * 3000)[:2000]])


def test_unknown_pipelines_are_an_error(spark):
    with pytest.raises(ValueError):
        c.contexts(pages(spark), tables(spark), ["text_only", "guess"])


def scan(spark, text):
    df = spark.createDataFrame([("d", "text_only", text)], "document_id string, pipeline string, context string")
    return {r.field_name: r.value for r in x.mock_scan(df).collect()}


def test_the_stand_in_model(spark):
    assert scan(spark, "Revenue: 50,000\nNet Income\n(10,000)\nTotal Assets\n\n$ 5") == {"revenue": "50,000", "net_income": "(10,000)"}
    assert scan(spark, "Total assets\n\n7.5\nEarnings per share (diluted) 1.25") == {"total_assets": "7.5", "eps": "1.25"}
    assert scan(spark, "| Revenue | 5 |") == {} and scan(spark, None) == {} and scan(spark, "") == {}
    assert scan(spark, "Revenue, which grew") == {"revenue": ","}  # a lone comma takes the field
    assert scan(spark, "Cost of revenue 7\nRevenue 9") == {"revenue": "7"}
    assert scan(spark, "Net income fell\nNet earnings 3") == {"net_income": "3"}


def test_replies_of_the_stand_in_model(spark):
    df = spark.createDataFrame([("d", "hybrid", 'Revenue 5 "q" é'), ("e", "hybrid", None)], "document_id string, pipeline string, context string")
    got = {r.document_id: r for r in x.mock_replies(df, "prompt").collect()}
    reply = json.loads(got["d"].text)
    assert reply["revenue"] == {"value": "5", "unit": "million USD", "currency": "USD", "source_text": 'Revenue 5 "q" é', "confidence": 0.7} and reply["eps"] is None
    assert got["d"].output_tokens == len(json.dumps(reply, indent=2)) // 4 and got["d"].input_tokens == max(1, len("prompt" + 'Revenue 5 "q" é') // 4)
    assert set(json.loads(got["e"].text).values()) == {None}


def mapped(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return {r.field_name: r for r in x.json_metrics(df).collect()}


def test_fields_of_replies(spark):
    got = mapped(spark, json.dumps({
        "revenue": {"value": "50 billion", "unit": "USD", "currency": "EUR", "source_text": " s ", "confidence": 0.5}, "net_income": 7, "operating_income": 8.0, "total_assets": "n/a",
        "total_liabilities": [1], "cash_and_equivalents": True, "eps": {"value": "1.5", "unit": ""},
    }))
    r = got["revenue"]
    assert (r.value, r.original_value, r.unit, r.currency, r.source_text, r.confidence, r.error) == (5e10, "50 billion", "billion USD", "EUR", "s", 0.5, None)
    assert (got["net_income"].value, got["net_income"].original_value, got["operating_income"].original_value) == (7.0, "7", "8.0")
    assert (got["cash_and_equivalents"].value, got["cash_and_equivalents"].original_value) == (1.0, "True")
    assert (got["total_assets"].error, got["total_liabilities"].error, got["total_assets"].value) == ("normalization", "unexpected_type", None)
    assert (got["eps"].value, got["eps"].unit) == (1.5, "USD per share")


def test_fields_that_arent_valid(spark):
    got = mapped(spark, json.dumps({"revenue": {"value": 5, "confidence": 1.5}, "net_income": {"value": 5, "source_text": "x" * 2001}, "eps": {"unit": "USD"}, "total_assets": {"value": None}, "total_liabilities": {"value": 3, "unit": 4}, "operating_income": {"value": "3", "currency": "euros"}}))
    assert {k: r.error for k, r in got.items() if r.error} == {"revenue": "validation", "net_income": "validation", "total_liabilities": "unit_type"}
    assert got["eps"].value is None and got["total_assets"].value is None and got["operating_income"].currency is None and len(got) == 7


@pytest.mark.parametrize("text", [None, "", "nothing", "[1]", "5", '{"a": NaN}', '{"a":'])
def test_replies_that_arent_objects(spark, text):
    assert mapped(spark, text) == {}
    assert x.unreadable(spark.createDataFrame([(1, text)], "id int, text string")).count() == 1


def test_reports(spark):
    df = spark.createDataFrame([(1, '{"revenue": 5}'), (2, '{"revenue": "x"}'), (3, "```json\n{}\n```")], "id int, text string")
    got = {r.id: r for r in x.reports(x.json_metrics(df), ["id"]).collect()}
    assert [(got[i].extracted, got[i].status) for i in (1, 2, 3)] == [(1, "partial"), (0, "invalid"), (0, "invalid")]
    assert got[2].errors == ["revenue: normalization", "no field was extracted"]


def test_validation(spark):
    box = lambda *b: F.array(*[F.lit(float(i)) for i in b])
    null = F.lit(None)
    check = lambda **o: one(spark.range(1).select(v.metric_errors(**{"value": F.lit(1.0), "currency": null.cast("string"), "bbox": null.cast("array<double>"), "confidence": null.cast("double"), "page": null.cast("int"), "source_text": null.cast("string")} | o).alias("x"))).x
    assert check() == [] and check(currency=F.lit(" usd "), bbox=box(0, 0, 1, 1), confidence=F.lit(1.0), page=F.lit(1)) == []
    assert check(value=F.lit(float("nan")), currency=F.lit("US"), bbox=box(1, 0, 1, 1), confidence=F.lit(1.1), page=F.lit(0), source_text=F.lit("x" * 2001)) == ["value", "currency", "bbox", "confidence", "page", "source_text"]
    assert check(bbox=box(0, 1, 2)) == ["bbox"] and check(value=null.cast("double")) == ["value"]
    years = spark.createDataFrame([(s,) for s in (" 2023 ", "1899", "2101", "23", "20x3", None)], "y string")
    assert [r.x for r in years.select(v.fiscal_year(F.col("y")).alias("x")).collect()] == [2023, None, None, None, None, None]
    bad = spark.range(1).select(v.provenance_errors(F.lit(-1), F.lit(1), F.lit(-0.1), F.lit(2.0), F.lit(-1.0)).alias("x"))
    assert one(bad).x == ["tokens", "cost", "confidence", "time"]


def test_consistency(spark):
    rows = [("a", "revenue", 5.0), ("a", "operating_income", 6.0), ("a", "total_assets", 5.0), ("a", "total_liabilities", 6.0), ("b", "revenue", 0.0), ("b", "operating_income", 6.0), ("c", "eps", 1.0)]
    got = {r.k: r.warnings for r in v.consistency(spark.createDataFrame(rows, "k string, field_name string, value double"), ["k"]).collect()}
    assert got == {"a": ["operating_income_above_revenue", "liabilities_above_assets"], "b": ["revenue_not_positive"], "c": []}


def test_sources_of_values(spark):
    df = pages(spark, (1, "d", 1, "x" * 150 + " Revenue 5,000 " + "y" * 150), (2, "d", 2, "5,000 again"), (3, "d", 3, "nothing"), (4, "e", 1, "5,000"))
    blocks = spark.createDataFrame([("d", 3, 4, "only 7 here", [1.0, 2.0, 3.0, 4.0]), ("d", 3, 2, "and 7 here", None), ("d", 9, 0, "8", None)], BLOCK)
    values = spark.createDataFrame([(1, "d", "5,000"), (2, "d", "7"), (3, "d", "8"), (4, "d", None), (5, "d", ""), (6, None, "5,000"), (7, "e", "5,000")], "value_id int, document_id string, printed string")
    got = {r.value_id: (r.page, r.source_text) for r in p.value_sources(values, df, blocks).collect()}
    assert got[1][0] == 1 and got[1][1].startswith("xxx") and "Revenue 5,000" in got[1][1]
    assert got[2] == (3, "and 7 here") and got[7] == (1, "5,000") and all(got[i] == (None, None) for i in (3, 4, 5, 6))


def test_first_table_with_a_word(spark):
    grids = tables(spark, (3, "a", 2, 0, [["NET income", "5"]]), (2, "a", 1, 1, [["net", "income"]]), (1, "a", 1, 0, [["other", None]]), (4, "b", 1, 0, None))
    assert [tuple(r) for r in p.first_table_with(grids, "net income").collect()] == [("a", 1, 1, 2)]


def test_prices(spark, tmp_path):
    prices = spark.createDataFrame([("gpt-x", 0, 2.0, 4.0), ("gpt-x-mini", 1, 1.0, 2.0), ("mock-model-v1", 2, 0.0, 0.0)], cost.PRICES)
    calls = spark.createDataFrame([(1, "gpt-x", 10**6, 10**6), (2, "gpt-x-mini-2024", 10**6, None), (3, "mock-model", 5, 5), (4, "other", 5, 5), (5, "gpt-x", None, None), (6, None, 1, 1), (7, "gpt-x-mini", 10**6, 0)], "id int, model string, input_tokens bigint, output_tokens bigint")
    out = cost.call_costs(calls, prices)
    got = {r.id: (r.price_key, r.priced, r.cost_usd) for r in out.collect()}
    assert got == {1: ("gpt-x", True, 6.0), 2: ("gpt-x", True, 2.0), 3: ("mock-model-v1", True, 0.0), 4: (None, False, None), 5: ("gpt-x", False, None), 6: (None, False, None), 7: ("gpt-x-mini", True, 1.0)}
    sums = {r.model: (r.cost_known_usd, r.cost_usd) for r in cost.cost_rollup(out, ["model"]).collect()}
    assert sums["mock-model"] == (0.0, None) and sums["other"] == (None, None) and sums["gpt-x"] == (6.0, 6.0)
    (tmp_path / "p.yaml").write_text("models:\n  b:\n    input_cost_per_1m_tokens: 1\n    output_cost_per_1m_tokens: 2\n  a:\n    input_cost_per_1m_tokens: 3\n    output_cost_per_1m_tokens: 4\n")
    assert [tuple(r) for r in cost.read_prices(spark, tmp_path / "p.yaml").orderBy("ordinal").collect()] == [("b", 0, 1.0, 2.0), ("a", 1, 3.0, 4.0)]
    assert cost.read_prices(spark, tmp_path / "none.yaml").count() == 0
