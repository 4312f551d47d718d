import datetime as dt
import time
import types

import pytest
from pyspark.sql import functions as F

from docmetrics import providers
from docmetrics.plans import core
from docmetrics.plans.experiment import Experiment
from docmetrics.schemas import TABLES
from docmetrics.sources import csv_records, documents as d, ground_truth as g, pages as p
from docmetrics.storage import Store, lookup, matching, newest, wide_reports
from docmetrics.streaming.ingest import call_windows, ingest_stream

GOOD = "Acme,2023,1,2,3,4,5,6,0.5,USD,million USD,src"


def reasons(spark, *lines):
    df = spark.createDataFrame(list(enumerate(lines)), "record_id bigint, raw_line string")
    return {r.record_id: r.reason for r in csv_records.rejected(df).collect()}, {r.record_id: r for r in csv_records.loaded(df).collect()}


def test_sound_and_damaged_records(spark):
    bad, good = reasons(
        spark, GOOD, '"Acme, Inc.",2023,"1,000", 2 ,+3,-4,5e3,,0.5,USD,unit,"say ""x"""', '"Acme,2023,1,2,3,4,5,6,7,8,9,10', 'Ac"me,2023,1,2,3,4,5,6,7,a,b,c', '"Acme"x,2023,1,2,3,4,5,6,7,a,b,c', GOOD + ",more", "Acme,2023",
        GOOD.replace("2023", "23"), GOOD.replace("2023", "2101"), GOOD.replace("0.5", "x"), GOOD.replace("0.5", "NaN"), GOOD.replace("0.5", "1e999"), "", None, GOOD.replace("src", '"line\nbreak"'), GOOD.replace("0.5", '"1,00"'), '"' + "x" * 100000 + '",2023,1,2,3,4,5,6,7,a,b,c',
    )
    assert bad == {2: "broken_quoting", 3: "broken_quoting", 4: "broken_quoting", 5: "column_count", 6: "column_count", 7: "invalid_value", 8: "invalid_value", 9: "invalid_value", 10: "invalid_value", 11: "invalid_value", 12: "column_count", 13: "column_count", 15: "invalid_value"}
    assert set(good) == {0, 1, 14, 16}
    r = good[1]
    assert (r.company, r.fiscal_year, r.revenue, r.net_income, r.operating_income, r.total_assets, r.total_liabilities, r.cash_and_equivalents, r.source) == ("Acme, Inc.", 2023, 1000.0, 2.0, 3.0, -4.0, 5000.0, None, 'say "x"')
    assert good[14].source == "line\nbreak"


def test_the_parse_isnt_written_out_again(spark):
    df = spark.createDataFrame([(1, GOOD)], "record_id bigint, raw_line string")
    assert csv_records.rejected(df)._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, GOOD, "mine", "other")], "record_id bigint, raw_line string, reason string, `a.b` string")
    row = csv_records.read_records(df).first()
    assert row.reason is None and row["a.b"] == "other" and row.record.company == "Acme"


def test_ground_truth_files(spark, tmp_path):
    head = "company,fiscal_year,revenue,net_income,operating_income,total_assets,total_liabilities,cash_and_equivalents,eps,currency,unit,source"
    (tmp_path / "gt.csv").write_text(f'{head}\n Acme ,2023,"1,000",,3,4,5,6,0.5,USD,million USD,a\nBad,2023,x,2,3,4,5,6,7,USD,u,s\nLate,year,1,2,3,4,5,6,7,USD,u,s\n')
    out = g.read_ground_truth(spark, str(tmp_path / "gt.csv"), g.read_ground_truth(spark, str(tmp_path / "gt.csv")).drop("ordinal").withColumn("company", F.lit("Extra")))
    rows = out.orderBy("ordinal").collect()
    assert [(r.company, r.revenue, r.net_income) for r in rows] == [("Acme", 1000.0, None), ("Extra", 1000.0, None)]
    assert g.skipped_rows(spark, str(tmp_path / "gt.csv")).count() == 2
    (tmp_path / "no.csv").write_text("company\nx\n")
    with pytest.raises(ValueError):
        g.read_ground_truth(spark, str(tmp_path / "no.csv"))


def test_names_of_files(spark):
    names = ["apple_2023_10k.pdf", "apple-2023-10k.pdf", "MSFT_FY2022_AR.pdf", "report.pdf", "acme annual report 2021.x.pdf", "2020.pdf", ".pdf"]
    df = spark.createDataFrame([(n,) for n in names], "f string")
    got = [(r.c, r.y) for r in df.select(d.name_company(F.col("f")).alias("c"), d.name_year(F.col("f")).alias("y")).collect()]
    assert got == [("apple_2023", None), ("apple", 2023), ("MSFT_FY2022", None), (None, None), ("acme", 2021), (None, 2020), (".pdf", None)]


def test_ingest_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("acme-2023.pdf", b"one"), ("copy-2022.PDF", b"one"), ("notes.txt", b"x"), ("given.pdf", b"two")):
        (tmp_path / "in" / name).write_bytes(body)
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    overrides = spark.createDataFrame([("given.pdf", "Given Ltd", 2020)], "filename string, company string, fiscal_year int")
    for _ in range(2):
        store.append("documents", d.ingest(d.read_files(spark, str(tmp_path / "in")), store.read("documents"), overrides))
    rows = {r.filename: r for r in store.documents().collect()}
    assert {(k, r.company, r.fiscal_year) for k, r in rows.items()} == {("acme-2023.pdf", "acme", 2023), ("given.pdf", "Given Ltd", 2020)}
    assert len(rows["given.pdf"].document_id) == 32 and rows["given.pdf"].file_size_bytes == 3
    one = rows["given.pdf"].document_id
    store.set_status(spark.createDataFrame([(one, "parsed")], "document_id string, status string"))
    assert lookup(store.documents(), "document_id", one).first().status == "parsed" and store.documents().where("status = 'ingested'").count() == 1
    with pytest.raises(ValueError):
        store.set_status(spark.createDataFrame([("none", "parsed")], "document_id string, status string"))
    store.drop()
    store.create()
    assert store.read("documents").count() == 0 and set(TABLES) == {"documents", "extractions", "metrics", "provenance", "evaluations", "failures", "experiments"}


def test_a_stream_of_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.create()
    rows = spark.createDataFrame([("a-2020.pdf", b"1", 1), ("b-2021.pdf", b"2", 1), ("c.pdf", b"1", 1)], "filename string, content binary, file_size_bytes bigint")
    for k in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        files = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        ingest_stream(files, store, str(tmp_path / "check"), once=True).awaitTermination()
        assert {r.filename for r in store.read("documents").collect()} == {"a-2020.pdf", "b-2021.pdf"}


def test_windows_of_calls(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10, 30)
    rows = spark.createDataFrame([(1, "m", at, 10.0), (1, "m", at, 10.0), (2, "m", at, -1.0), (3, "m", at + dt.timedelta(hours=1), None), (4, "m", None, 1.0)], "call_id bigint, model string, called_at timestamp_ntz, latency_ms double")
    got = {(r.start.hour, r.calls, r.mean_latency_ms) for r in call_windows(rows).collect()}
    assert got == {(10, 2, 10.0), (11, 1, None)}
    rows.write.parquet(str(tmp_path / "in"))
    stream = call_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.start.hour, r.calls) for r in spark.table("w").collect()} == {(10, 2), (11, 1)}


def test_parsers(spark):
    files = spark.createDataFrame([("d", b"one\n\ntwo\fthree"), ("e", b""), ("f", None)], "document_id string, content binary")
    parsed = p.parse(files, "plain").cache()
    assert {(r.document_id, r.page_number, r.full_text) for r in p.page_rows(parsed).collect()} == {("d", 1, "one\n\ntwo"), ("d", 2, "three"), ("e", 1, "")}
    assert {(r.page, r.text, r.block_index) for r in p.block_rows(parsed).where("document_id = 'd'").collect()} == {(1, "one", 0), (1, "two", 1), (2, "three", 0)}
    assert p.page_rows(p.parse(files, "plain", 1)).where("document_id = 'd'").count() == 1

    def odd(content, most):
        if content == b"":
            raise ValueError("empty")
        return [{"page_number": 1, "text": "t", "width": 1.0, "height": 2.0, "blocks": [], "tables": [{"rows": [["Item", None], ["a", "5"]], "bbox": None, "table_index": 0}, {"rows": [], "bbox": None, "table_index": 1}]}]

    parsed = p.parse(files, odd).cache()
    assert {r.document_id: r.error for r in parsed.collect()} == {"d": None, "e": "ValueError: empty"}
    row = p.table_rows(parsed).first()
    assert (row.rows, row.headers) == ([["Item", ""], ["a", "5"]], ["Item", ""]) and [tuple(r) for r in p.page_counts(parsed).collect()] == [("d", 1, 2)]
    missing = p.parse(files.where("document_id = 'd'"), "text").first()
    assert missing.error is None or "ModuleNotFoundError" in missing.error


def test_grids_of_cells(spark):
    cells = spark.createDataFrame([("t", 0, 0, "a"), ("t", 1, 2, "b"), ("t", 1, 2, None), ("u", 0, 0, None)], "k string, row int, col int, text string")
    assert {r.k: r.rows for r in p.grid(cells, ["k"]).collect()} == {"t": [["a", "", ""], ["", "", "b"]], "u": [[""]]}


def test_grids_of_scattered_cells(spark):
    rows = [("t", 4, 1, "b"), ("t", 1, 0, "z"), ("t", 1, 0, "a"), ("t", 1, 3, None), ("t", -1, 9, "x"), ("t", None, 9, "x"), ("t", 9, None, "x"), (None, 0, 2, "n")]
    want = {"t": [["", "", "", ""], ["z", "", "", ""], ["", "", "", ""], ["", "", "", ""], ["", "b", "", ""]], None: [["", "", "n"]]}
    for kind in ("int", "bigint"):
        got = p.grid(spark.createDataFrame(rows, f"k string, row {kind}, col {kind}, text string"), ["k"])
        assert {r.k: r.rows for r in got.collect()} == want


@pytest.mark.parametrize("lost", [-1, 7])
def test_the_time_of_a_grid_grows_with_its_cells(spark, lost):
    cells = spark.range(10_000).where(f"id <> {lost}").selectExpr("'t' AS k", "CAST(id DIV 4 AS INT) AS row", "CAST(id % 4 AS INT) AS col", "CAST(id AS STRING) AS text")
    began = time.perf_counter()
    assert p.grid(cells, ["k"]).first().rows == [["" if 4 * r + c == lost else str(4 * r + c) for c in range(4)] for r in range(2500)]
    assert time.perf_counter() - began < 20  # minutes where every cell is searched for among all


def test_table_grid_keeps_empty_rows_and_tables_of_one_id(spark, tmp_path):
    rows = [(1, [["a"], []]), (1, [["b", None], None, ["c", "d", ""]]), (None, [["x"]]), (None, [[None]]), (2, None), (3, []), (4, [[], None])]
    spark.createDataFrame(rows, "table_id bigint, rows array<array<string>>").write.parquet(str(tmp_path / "parsed_tables.parquet"))
    got = [(r.table_id, r.text) for r in core.table_grid(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([(1, "| a |\n|  |"), (1, "| b |  |  |\n|  |  |  |\n| c | d |  |"), (None, "| x |"), (None, "|  |")], key=repr)


def echo():
    """Made in the task, as a factory is; a class of this file couldn't be read there."""
    from docmetrics.providers import Reply

    class Echo:
        name, model = "echo", "echo-1"

        def extract(self, prompt, context):
            if "boom" in context:
                raise RuntimeError("down")
            return Reply('{"revenue": 5}' if "isn't a JSON object" in context else context, 3, None)

    return Echo()


def test_models_as_functions(spark):
    made = types.FunctionType(echo.__code__, {"__builtins__": __builtins__}, "made")  # shipped by value
    contexts = spark.createDataFrame([("a", "hybrid", "not json"), ("b", "other", '{"eps": 1}'), ("c", "hybrid", "boom")], "document_id string, pipeline string, context string")
    out = providers.call_models(contexts.withColumn("prompt", F.lit("p")), made, attempts=2, wait=0.0)
    got = {r.document_id: r for r in providers.corrected(out, made).collect()}
    assert got["a"].text == '{"revenue": 5}' and got["b"].text == '{"eps": 1}' and got["c"].text is None and got["c"].error == "RuntimeError: down"
    assert (got["a"].input_tokens, got["a"].output_tokens, got["a"].model) == (3, None, "echo-1")
    assert providers.pending(contexts, out.where("document_id = 'a'")).count() == 2
    with pytest.raises(ValueError):
        providers.replies(contexts, "nobody")
    assert providers.prompt_for("nobody") == providers.prompt_for("text_only")


def test_reading_back(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", None, "x"), ("c", 3, "y")], "k string, t int, p string")
    assert [r.k for r in newest(df, "t", "k", 2).collect()] == ["c", "a"]
    assert {r.k for r in matching(df, p="x", k=None).collect()} == {"a", "b"} and matching(df, p="").count() == 3
    long = spark.createDataFrame([("r", "eps", 1.0), ("r", "eps", 2.0)], "k string, field_name string, value double")
    row = wide_reports(long, ["k"]).first()
    assert row.eps == 2.0 and row.revenue is None


def test_a_whole_experiment(spark, tmp_path):
    docs = spark.createDataFrame([("d", "Acme", 2023), ("bad", "Acme", 0)], "document_id string, company string, fiscal_year int")
    pages = spark.createDataFrame([(1, "d", 1, "Income\nRevenue 50,000\nNet Income (10)\nOperating Income: 60,000"), (2, "bad", 1, "Revenue 5")], "page_id bigint, document_id string, page_number int, full_text string")
    blocks = spark.createDataFrame([], "document_id string, page int, block_index int, text string, bbox array<double>")
    tables = spark.createDataFrame([(1, "d", 1, 0, [["Revenue", "50,000"]])], "table_id bigint, document_id string, page int, table_index int, rows array<array<string>>")
    records = spark.createDataFrame([(1, "ACME", 2023, 50000.0, 10.0, None, None, None, None, None, "USD", "million USD", None)], "gt_id bigint, company string, fiscal_year int, revenue double, net_income double, operating_income double, total_assets double, total_liabilities double, cash_and_equivalents double, eps double, currency string, unit string, source string")
    prices = spark.createDataFrame([("mock-model-v1", 0, 1.0, 1.0)], "key string, ordinal int, input_per_million double, output_per_million double")
    run = Experiment(docs, pages, blocks, tables, records, prices)
    assert run.rejected.count() == 1 and run.calls.count() == 3
    reports = {r.pipeline: r for r in run.reports.collect()}
    assert {k: (r.extracted, r.status) for k, r in reports.items()} == {k: (3, "partial") for k in ("text_only", "layout_aware", "hybrid")}
    assert reports["hybrid"].errors == ["operating_income_above_revenue"] and reports["text_only"].errors == []
    assert {(r.pipeline, r.field_name, r.failure_type) for r in run.failures.collect()} == {(k, "net_income", "SIGN_ERROR") for k in reports}
    assert {r.pipeline: (r.documents, r.exact_accuracy_pct) for r in run.summary().collect()} == {k: (1, 50.0) for k in reports}
    assert {r.page for r in run.provenance.collect()} == {1} and run.provenance.count() == 9
    costs = run.costs.first()
    assert costs.cost_usd > 0 and costs.cost_per_field_usd == pytest.approx(3 * costs.cost_usd)

    from docmetrics.storage import run_rows, write_summary

    store = Store(spark, str(tmp_path / "s"))
    store.create()
    for _ in range(2):
        extractions, rows = run_rows(run.reports, run.metrics)
        store.append("extractions", extractions)
        store.append("metrics", rows)
    assert store.read("extractions").count() == 3 and store.read("metrics").count() == 9
    write_summary(run.summary(), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).count() == 3


def test_the_sample_report(spark):
    from docmetrics.sources import sample

    parsed = sample.sample_parsed(spark)
    pages = p.page_rows(parsed).withColumn("page_id", F.monotonically_increasing_id())
    tables = p.table_rows(parsed).withColumn("table_id", F.monotonically_increasing_id())
    records = spark.createDataFrame([(1, sample.COMPANY, sample.YEAR, 50000.0, 9000.0, 12000.0, 120000.0, 70000.0, 15000.0, 4.5, "USD", "million USD", None)], "gt_id bigint, company string, fiscal_year int, revenue double, net_income double, operating_income double, total_assets double, total_liabilities double, cash_and_equivalents double, eps double, currency string, unit string, source string")
    prices = spark.createDataFrame([], "key string, ordinal int, input_per_million double, output_per_million double")
    run = Experiment(sample.sample_document(spark), pages, p.block_rows(parsed), tables, records, prices)
    got = {(r.pipeline, r.field_name): r.value for r in run.metrics.where("value IS NOT NULL").collect()}
    assert {got[k, "revenue"] for k in ("text_only", "layout_aware", "hybrid")} == {50000.0}
    assert {r.pipeline: r.exact_accuracy_pct for r in run.summary().collect()}["text_only"] == 100.0
    assert tables.first().headers == ["Item", "2023"] or tables.first().headers == []
    assert [r.running for r in p.numbered(p.block_rows(parsed)).where("page = 1").orderBy("running").collect()] == [0, 1, 2]


def test_settings():
    from docmetrics.settings import Settings

    s = Settings.read({"DOCMETRICS_PROVIDER": "OpenAI", "DOCMETRICS_LOG_LEVEL": "info", "DOCMETRICS_ATTEMPTS": "5", "OTHER": "x"}, model="m")
    assert (s.provider, s.log_level, s.attempts, s.model, s.parser) == ("openai", "INFO", 5, "m", "text")
    with pytest.raises(TypeError):
        Settings.read({}, nothing=1)
